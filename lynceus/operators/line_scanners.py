"""Scanners that look at one line at a time.

Each scanner is a column: the array of hits of a line, `struct<scanner, rule_id, pos, message>`. All
scanners' arrays are concatenated and exploded in one projection over the lines, so a corpus is
scanned once whatever the number of rules, and no rule is joined with lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import text as X
from lynceus.rules import catalogue as R
from lynceus.sources.config import Config

MARKDOWN = ("md", "markdown")
SHELL = ("sh", "bash", "zsh")
#: Files that each scanner reads; extensions in lower case.
EXTENSIONS = {
    "prompt": ("md", "txt", "yaml", "yml"),
    "bash_patterns": SHELL,
    "typescript_patterns": ("ts", "tsx", "mts", "js", "mjs"),
    "package_install": SHELL,
    "malicious_urls": (*MARKDOWN, *SHELL),
    "obfuscation": MARKDOWN,
    "pii": (*MARKDOWN, *SHELL),
    "script_mixing": MARKDOWN,
}
HIT = "array<struct<scanner:string,rule_id:string,pos:int,message:string>>"


def none() -> Column:
    return F.array().cast(HIT)


def hit(scanner: str, rule: str, message: Column | str, pos: Column | int = 0) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(scanner).alias("scanner"), F.lit(rule).alias("rule_id"), as_column(pos).cast("int").alias("pos"), as_column(message).alias("message"))


def when_hits(*tests: tuple[Column, R.Rule]) -> Column:
    return F.array_compact(F.array(*(F.when(t, hit(r.scanner, r.id, r.message)) for t, r in tests))).cast(HIT)


def hits_of(values: Column, test: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """A hit for each value that passes, in the order of the values."""
    return F.array_compact(F.transform(values, lambda v, i: F.when(test(v), made(v, i)))).cast(HIT)


def shell_comment(line: Column) -> Column:
    return X.let(X.trim(line), lambda t: t.startswith("#") & ~t.startswith("#!"))


def ignored(line: Column, config: Config | None = None) -> Column:
    """Whether a line ends in an inline mark, of a fixed name or one that the configuration adds."""
    return marked(line, R.IGNORE_HASH, config)


def marked(line: Column, pattern: str, config: Config | None) -> Column:
    more = "".join(f"|{re.escape(m)}" for m in (config.marks if config else ()) if m)
    return X.matches(line, pattern.replace("):ignore", f"{more}):ignore"))


def bash(line: Column, config: Config) -> Column:
    rules = [(X.matches(line, r.pattern), r) for r in R.BASH[:-1]]
    network = R.BASH[-1]
    gated = X.matches(line, network.pattern) & ~X.all_hosts_allowed(line, config.domains)
    return F.when(~shell_comment(line) & ~ignored(line, config), when_hits(*rules, (gated, network))).otherwise(none())


def typescript(line: Column, config: Config) -> Column:
    rules = [(X.matches(line, r.pattern), r) for r in R.TYPESCRIPT[:-1]]
    network = R.TYPESCRIPT[-1]
    gated = X.matches(line, network.pattern) & ~X.all_hosts_allowed(line, config.domains)
    skipped = X.trim(line).startswith("//") | marked(line, R.IGNORE_SLASHES, config)
    return F.when(~skipped, when_hits(*rules, (gated, network))).otherwise(none())


def prompt(line: Column, stem: Column) -> Column:
    return F.when(~F.lower(stem).isin(*R.BENIGN_STEMS), when_hits(*((X.matches(line, r.pattern), r) for r in R.PROMPT))).otherwise(none())


def package_install(line: Column, config: Config) -> Column:
    *managers, latest, registry = R.PACKAGE
    named, indexed = X.matches(line, R.HAS_REGISTRY), X.matches(line, R.HAS_INDEX)
    tests = [(X.matches(line, r.pattern) & ~(indexed if r.id == "pkg/F1-pip" else named), r) for r in managers]
    url = F.regexp_extract(line, X.rx(registry.pattern), 1)
    host = F.lower(F.regexp_extract(url, X.rx(X.HOST), 1))
    foreign = (url != "") & ~((host != "") & X.in_list(host, config.registries))
    first = when_hits(*tests, (X.matches(line, latest.pattern), latest))
    last = F.when(foreign, F.array(hit(registry.scanner, registry.id, F.concat(F.lit(f"{registry.message}: "), url)))).otherwise(none())
    return F.when(~shell_comment(line) & ~ignored(line, config), F.concat(first, last)).otherwise(none())


def addresses(line: Column) -> Column:
    """The URLs of a line: array of struct scheme, raw (host as written), host (lower case)."""
    made = lambda scheme, raw: F.struct(F.lower(scheme).alias("scheme"), raw.alias("raw"), ascii_lower(raw).alias("host"))
    return F.zip_with(X.every(line, R.URL, 1), X.every(line, R.URL, 2), made)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def urls(line: Column, config: Config) -> Column:
    shortener, paste, literal, tld, plain = R.URLS

    def of(u: Column, i: Column) -> Column:
        host = u["host"]
        ip = X.matches(host, R.IP_HOST)
        ends = F.regexp_extract(host, rf"(\.(?:{'|'.join(R.ABUSED_TLDS)}))\z", 1)
        say = lambda rule, *more: hit(rule.scanner, rule.id, F.concat(F.lit(f"{rule.message}: "), *more), i)
        several = F.array_compact(
            F.array(
                F.when(host.isin(*R.PASTE_SITES), say(paste, host)),
                F.when(host.isin(*R.SHORTENERS), say(shortener, host)),
                F.when(ends != "", say(tld, ends, F.lit(" in "), host)),
                F.when(u["scheme"] == "http", say(plain, host)),
            )
        ).cast(HIT)
        skipped = (host == "") | X.in_list(host, config.domains)
        return F.when(skipped, none()).when(ip, F.array(say(literal, u["raw"])).cast(HIT)).otherwise(several)

    return F.when(~ignored(line, config), F.flatten(F.transform(addresses(line), of))).otherwise(none())


def tokens(line: Column) -> Column:
    """Tokens of prose: without inline code and addresses, trimmed of punctuation."""
    bare = F.regexp_replace(F.regexp_replace(line, "`[^`]*`", " "), X.rx(r"https?://\S+"), " ")
    words = F.filter(F.split(bare, X.rx(r"\s+")), lambda t: t != "")
    ends = r"""[.,;:!?()\[\]"'*_]+"""
    return F.transform(words, lambda t: F.regexp_replace(t, rf"\A{ends}|{ends}\z", ""))


MIN_TOKEN, MIN_BASE64, MIN_HEX, MAX_ENTROPY = 40, 60, 40, 4.5


def is_base64(t: Column) -> Column:
    return (F.octet_length(t) >= MIN_BASE64) & t.rlike(r"\A[A-Za-z0-9+/=-]+\z") & t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9+/=]")


def is_hex(t: Column) -> Column:
    return (F.octet_length(t) >= MIN_HEX) & t.rlike(r"\A[0-9A-Fa-f]+\z")


def obfuscation(line: Column, in_prose: Column, config: Config | None = None) -> Column:
    base64, hexed, high = R.OBFUSCATION

    def of(t: Column, i: Column) -> Column:
        size = F.octet_length(t).cast("string")
        say = lambda r, bits=None: hit(r.scanner, r.id, F.concat(F.lit(f"{r.message} ("), size, F.lit(" bytes"), *([F.lit(", "), F.format_number(bits, 2), F.lit(" bits")] if bits is not None else []), F.lit("): "), F.substring(t, 1, 24)), i)
        bits = X.entropy(t)
        return F.when(F.octet_length(t) >= MIN_TOKEN, F.when(is_base64(t), say(base64)).when(is_hex(t), say(hexed)).when(bits > MAX_ENTROPY, say(high, bits)))

    return F.when(in_prose & ~ignored(line, config) & (F.octet_length(line) >= MIN_TOKEN), F.array_compact(F.transform(tokens(line), of)).cast(HIT)).otherwise(none())


def example_email(address: Column) -> Column:
    """Addresses that stand for none: at a domain or with a local part that is made for examples."""
    low = F.lower(address)
    local, domain = F.split_part(low, F.lit("@"), F.lit(1)), F.substring_index(low, "@", -1)
    suffix = reduce(lambda a, s: a | domain.endswith(s), R.EXAMPLE_SUFFIXES, F.lit(False))
    return domain.isin(*R.EXAMPLE_DOMAINS) | suffix | local.isin(*R.EXAMPLE_LOCALS)


def parts(value: Column, pattern: str, n: int) -> list[Column]:
    """Groups of a match as numbers, 0 where they are none in ASCII digits."""
    return [F.coalesce(F.when(g.rlike(r"\A[0-9]+\z"), g.cast("int")), F.lit(0)) for g in (F.regexp_extract(value, X.rx(pattern), k) for k in range(1, n + 1))]


def placeholder_ssn(value: Column) -> Column:
    area, group, serial = parts(value, R.SSN, 3)
    return ((area == 123) & (group == 45) & (serial == 6789)) | area.isin(0, 666) | area.between(900, 999) | (group == 0) | (serial == 0)


def card_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def private_ipv4(value: Column) -> Column:
    a, b, c, d = parts(value, R.IPV4, 4)
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127) | ((a == 169) & (b == 254))
    return private & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)


def pii(line: Column, config: Config | None = None) -> Column:
    email, ssn, card, private, internal = R.PII
    plain = lambda r: lambda v, i: hit(r.scanner, r.id, r.message, i)
    found = F.concat(
        hits_of(X.every(line, R.EMAIL), lambda v: ~example_email(v), plain(email)),
        hits_of(X.every(line, R.SSN), lambda v: ~placeholder_ssn(v), plain(ssn)),
        hits_of(
            X.every(line, R.CARD),
            lambda v: F.length(card_digits(v)).between(13, 19) & F.call_function("luhn_check", card_digits(v)),
            lambda v, i: hit(card.scanner, card.id, F.concat(F.lit(f"{card.message} ("), F.length(card_digits(v)).cast("string"), F.lit(" digits)")), i),
        ),
        hits_of(X.every(line, R.IPV4), private_ipv4, plain(private)),
        hits_of(X.every(line, R.INTERNAL_HOST), lambda v: F.lit(True), plain(internal)),
    )
    return F.when(~ignored(line, config), found).otherwise(none())


def redact(line: Column) -> Column:
    """line with every match of the five kinds replaced, whether it would be a finding or not."""
    for pattern, mark in R.REDACTIONS:
        line = F.regexp_replace(line, X.rx(pattern), mark)
    return line


LOOKALIKE = "[" + "".join(map(chr, R.HOMOGLYPHS)) + "]"
TURNING = "[‪-‮⁦-⁩]"
LATIN, CYRILLIC_OR_GREEK = "[A-Za-z0-9Ā-ɏ]", "[Ѐ-ӿͰ-Ͽ]"


def homoglyph_message(value: Column) -> Column:
    """Names the first look-alike and the Latin letter that it stands for."""
    first = F.regexp_extract(value, f"({LOOKALIKE})", 1)
    names = F.create_map(*(c for code, latin in R.HOMOGLYPHS.items() for c in (F.lit(chr(code)), F.lit(f"U+{code:04X} for {latin}"))))
    return F.concat(F.lit(f"{R.SCRIPTS[0].message}: "), F.element_at(names, first))


def script_hits(value: Column, field: bool) -> Column:
    lookalike, turning, several = R.SCRIPTS
    found = [F.when(value.rlike(TURNING), hit(turning.scanner, turning.id, turning.message)), F.when(value.rlike(LOOKALIKE), hit(lookalike.scanner, lookalike.id, homoglyph_message(value)))]
    if field:
        found.append(F.when(value.rlike(LATIN) & value.rlike(CYRILLIC_OR_GREEK), hit(several.scanner, several.id, several.message)))
    return F.array_compact(F.array(*found)).cast(HIT)


def script_mixing(line: Column, in_prose: Column, in_head: Column, config: Config | None = None) -> Column:
    """A metadata field's value first, then the line itself: a line of the head is reported by both."""
    key, value = F.lower(X.trim(F.substring_index(line, ":", 1))), X.trim(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))
    field = in_head & line.contains(":") & ~X.trim(line).startswith("#") & key.isin("name", "description", "compatibility") & (value != "") & ~ignored(line, config)
    body = in_prose & ~ignored(line, config) & (X.trim(line) != "---")
    return F.concat(F.when(field, script_hits(value, True)).otherwise(none()), F.when(body, script_hits(line, False)).otherwise(none()))


def with_states(lines: DataFrame) -> DataFrame:
    """Lines with what earlier lines of the file decide: prose outside fences, and the metadata head.

    Only Markdown needs the windows; other lines don't go through the sort.
    """
    file = Window.partitionBy("artifact_id", "path").orderBy("line_no")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.where(F.col("ext").isin(*MARKDOWN)).withColumns({"_fence": X.matches(F.col("line"), r"^\s*```").cast("int"), "_rule": (X.trim(F.col("line")) == "---").cast("int")})
    sentinel = F.col("file_name").isin("SKILL.md", "AGENT.md")
    states = marked.withColumns(
        {
            "in_prose": (F.sum("_fence").over(upto) % 2 == 0) & (F.col("_fence") == 0),
            "in_head": sentinel & (F.first("_rule").over(upto) == 1) & (F.sum("_rule").over(upto) == 1) & (F.col("line_no") > 1),
        }
    ).drop("_fence", "_rule")
    rest = lines.where(~F.col("ext").isin(*MARKDOWN)).withColumns({"in_prose": F.lit(True), "in_head": F.lit(False)})
    return states.unionByName(rest)


def all_hits(config: Config) -> Column:
    line = F.col("line")
    columns = {
        "prompt": prompt(line, F.col("stem")),
        "bash_patterns": bash(line, config),
        "typescript_patterns": typescript(line, config),
        "package_install": package_install(line, config),
        "malicious_urls": urls(line, config),
        "obfuscation": obfuscation(line, F.col("in_prose"), config),
        "pii": pii(line, config),
        "script_mixing": script_mixing(line, F.col("in_prose"), F.col("in_head"), config),
    }
    return F.concat(*(F.when(reads(s), c).otherwise(none()) for s, c in columns.items() if config.enabled(s)), none())


def reads(scanner: str) -> Column:
    """Whether a scanner reads the file; script_mixing minds the case of extensions."""
    if scanner == "script_mixing":
        return F.col("ext_raw").isin(*MARKDOWN) | F.col("file_name").isin("SKILL.md", "AGENT.md")
    return F.col("ext").isin(*EXTENSIONS[scanner])


def scan_lines(lines: DataFrame, config: Config) -> DataFrame:
    """Findings of all line scanners, with the place of a hit within its line."""
    hits = with_states(lines).withColumn("h", F.explode(all_hits(config)))
    snippet = (
        F.when(F.col("h.scanner").isin("bash_patterns", "prompt", "typescript_patterns"), X.snippet_cut_first(F.col("line")))
        .when(F.col("h.scanner") == "pii", X.snippet_trim_first(redact(F.col("line"))))
        .otherwise(X.snippet_trim_first(F.col("line")))
    )
    return hits.select("artifact_id", "path", F.col("line_no").alias("line"), "h.scanner", "h.rule_id", "h.pos", "h.message", snippet.alias("snippet"))
