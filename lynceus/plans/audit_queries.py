"""One query for each operator of the audit, with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.functions import text as X
from lynceus.operators import external, findings as A, line_scanners as L, metadata as M
from lynceus.plans import samples as S
from lynceus.plans.engine import audit
from lynceus.rules import catalogue as R
from lynceus.sinks import reports as O
from lynceus.sources import files as Fs
from lynceus.sources.config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else quoted(v) for v in r) + ")" for r in rows)


# ---- inputs: documents as files, lines from samples and orders, metadata files from samples and customers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return Fs.from_rows(d, F.col("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")), F.col("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fs.lines_of(document_files(spark, sf_dir))


def spread(df: DataFrame) -> DataFrame:
    """A table as it was read, but over all cores if it has fewer splits than those, as only small tables have."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(S.LINES)], "i int, ext string, t string")
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    made = o.join(F.broadcast(rows), F.col("o_orderkey") % len(S.LINES) == F.col("i"))
    artifact = F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string"))
    path = F.concat(artifact, F.lit("/f."), F.col("ext"))
    name = F.concat(F.lit("f."), F.col("ext"))
    return made.select(artifact.alias("artifact_id"), path.alias("path"), name.alias("file_name"), F.lit("f").alias("stem"), "ext", F.col("ext").alias("ext_raw"), F.col("o_orderkey").alias("line_no"), F.replace(F.col("t"), F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("line"))


def metadata_files(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    samples = S.SKILLS if mode == "skill" else S.AGENTS
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    c = spread(table(spark, sf_dir, "customer").select("c_custkey"))
    name = F.concat(F.lit(f"{mode}-"), F.col("c_custkey").cast("string"))
    artifacts = c.select(name.alias("artifact_id"), name.alias("name"))
    with_file = c.where("c_custkey % 11 <> 0").join(F.broadcast(rows), F.col("c_custkey") % len(samples) == F.col("i"))
    path = F.concat(name, F.lit(f"/{Fs.SENTINELS[mode]}"))
    content = F.replace(F.col("t"), F.lit("{k}"), F.col("c_custkey").cast("string"))
    files = Fs.from_rows(with_file, name, path, content).withColumn("rel_path", F.lit(Fs.SENTINELS[mode]))
    readme = Fs.from_rows(c.where("c_custkey % 13 = 0"), name, F.concat(name, F.lit("/README.md")), F.lit("Read me")).withColumn("rel_path", F.lit("README.md"))
    return files.unionByName(readme), artifacts


DOC_LINES = r"""
dl0 AS (SELECT doc_id, text, string_split(regexp_replace(text, '\r\n', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
dl1 AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM dl0),
dl AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM dl1)"""
SAMPLE_LINES = f"""
tl AS (SELECT 'a' || (o_custkey % 40) AS artifact_id, 'a' || (o_custkey % 40) || '/f.' || ext AS path, ext, o_orderkey AS line_no,
         replace(t, '{{k}}', o_orderkey::VARCHAR) AS line
  FROM orders JOIN ({values((i, e, t) for i, (e, t) in enumerate(S.LINES))}) s(i, ext, t) ON o_orderkey % {len(S.LINES)} = i)"""
IGNORED = f"regexp_matches(line, {quoted(R.IGNORE_HASH)})"
COMMENT = r"(regexp_matches(line, '^\s*#') AND NOT regexp_matches(line, '^\s*#!'))"
SNIP_FIRST = r"regexp_replace(CASE WHEN strlen(line) > 120 THEN left(line, 117) || '...' ELSE line END, '^\s+|\s+$', '', 'g')"
HOST_SQL = quoted(X.HOST)


def allowed_sql(host: str, entries) -> str:
    return "regexp_matches(" + host + ", '(^|\\.)(" + "|".join(e.replace(".", "\\.") for e in entries) + ")$')"


ALL_ALLOWED = f"""(len(regexp_extract_all(line, {HOST_SQL}, 1)) > 0 AND len(list_filter(regexp_extract_all(line, {HOST_SQL}, 1), lambda h: NOT {allowed_sql("lower(h)", R.DOMAINS)})) = 0)"""


def only(*scanners: str) -> Config:
    return Config(scanners={s: s in scanners for s in L.EXTENSIONS})


def scanned(spark: SparkSession, sf_dir: str, *scanners: str) -> DataFrame:
    return L.scan_lines(sample_lines(spark, sf_dir), only(*scanners))


def pattern_sql(rules, where: str, gates: dict[str, str] | None = None) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(line, {quoted(r.pattern)}){(gates or {}).get(r.id, '')} THEN {quoted(r.id)} END" for r in rules)
    return f"""WITH {SAMPLE_LINES}
SELECT path, line_no AS line, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS rule_id, {SNIP_FIRST} AS snippet FROM tl WHERE {where}"""


# ---- sources


@query(f"WITH {DOC_LINES} SELECT doc_id::VARCHAR AS artifact_id, line_no, line FROM dl")
def lines_explode(spark, sf_dir):
    return document_lines(spark, sf_dir).select("artifact_id", "line_no", "line")


@query("SELECT 'doc_' || doc_id || '.md' AS path, 'doc_' || doc_id AS stem, 'md' AS ext, strlen(text)::BIGINT AS length, md5(text) AS content_md5 FROM documents")
def virtual_files(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", "stem", "ext", "length", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""SELECT page_id, CASE WHEN strlen(html) * 5000 > 10485760 THEN 'file of ' || strlen(html) * 5000 || ' bytes exceeds 10485760' WHEN page_id % 3 = 0 THEN 'not UTF-8' END AS read_error FROM pages""")
def utf8_size_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    content = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("FFFE41"))).otherwise(F.col("html").cast("binary"))
    return p.select("page_id", Fs.guarded(F.octet_length("html").cast("long") * 5000, content)[1].alias("read_error"))


@query("SELECT DISTINCT 'skill-' || c_custkey AS artifact_id FROM customer WHERE c_custkey % 11 <> 0")
def collection_discovery(spark, sf_dir):
    return Fs.artifacts_of(metadata_files(spark, sf_dir, "skill")[0], "skill")


# ---- line scanners


@query(pattern_sql(R.BASH, f"ext = 'sh' AND NOT {COMMENT} AND NOT {IGNORED}", {"bash/CAT-H1": f" AND NOT {ALL_ALLOWED}"}))
def bash_multi_match(spark, sf_dir):
    return scanned(spark, sf_dir, "bash_patterns").select("path", "line", "rule_id", "snippet")


@query(pattern_sql(R.TYPESCRIPT, rf"ext = 'ts' AND NOT regexp_matches(line, '^\s*//') AND NOT regexp_matches(line, {quoted(R.IGNORE_SLASHES)})", {"typescript/CAT-H1": f" AND NOT {ALL_ALLOWED}"}))
def ts_multi_match(spark, sf_dir):
    return scanned(spark, sf_dir, "typescript_patterns").select("path", "line", "rule_id", "snippet")


@query(pattern_sql(R.PROMPT, "ext = 'md'"))
def prompt_multi_match(spark, sf_dir):
    return scanned(spark, sf_dir, "prompt").select("path", "line", "rule_id", "snippet")


_GATES = {r.id: f" AND NOT regexp_matches(line, {quoted(R.HAS_INDEX if 'pip' in r.id else R.HAS_REGISTRY)})" for r in R.PACKAGE[:5]}
_GATES["pkg/F3-registry"] = f""" AND NOT {allowed_sql(f"lower(regexp_extract(regexp_extract(line, {quoted(R.PACKAGE[-1].pattern)}, 1), {HOST_SQL}, 1))", R.REGISTRIES)}"""


@query(pattern_sql(R.PACKAGE, f"ext = 'sh' AND NOT {COMMENT} AND NOT {IGNORED}", _GATES))
def pkg_install(spark, sf_dir):
    return scanned(spark, sf_dir, "package_install").select("path", "line", "rule_id", "snippet")


_URL_SQL = f"""
u0 AS (SELECT path, line_no AS line, unnest(list_zip(regexp_extract_all(line, {quoted(R.URL)}, 1), regexp_extract_all(line, {quoted(R.URL)}, 2))) AS u FROM tl WHERE ext IN ('md', 'sh') AND NOT {IGNORED}),
us AS (SELECT path, line, lower(u[1]) AS scheme, lower(u[2]) AS host, {allowed_sql("lower(u[2])", R.DOMAINS)} AS allowed, regexp_matches(lower(u[2]), {quoted(R.IP_HOST)}) AS ip FROM u0)"""
_LISTED = lambda names: "(" + ", ".join(map(quoted, names)) + ")"


@query(f"WITH {SAMPLE_LINES}, {_URL_SQL} SELECT path, line, scheme, host, allowed, ip FROM us")
def url_extract(spark, sf_dir):
    lines = sample_lines(spark, sf_dir).where(F.col("ext").isin("md", "sh") & ~L.ignored(F.col("line")))
    rows = lines.select("path", F.col("line_no").alias("line"), F.explode(L.addresses(F.col("line"))).alias("u"))
    return rows.select("path", "line", "u.scheme", "u.host", X.in_list(F.col("u.host"), R.DOMAINS).alias("allowed"), X.matches(F.col("u.host"), R.IP_HOST).alias("ip"))


@query(f"""WITH {SAMPLE_LINES}, {_URL_SQL}
SELECT path, line, unnest(list_filter(CASE WHEN ip THEN ['url/U3-ip-literal'] ELSE [
  CASE WHEN host IN {_LISTED(R.PASTE_SITES)} THEN 'url/U2-paste' END, CASE WHEN host IN {_LISTED(R.SHORTENERS)} THEN 'url/U1-shortener' END,
  CASE WHEN regexp_matches(host, '\\.({"|".join(R.ABUSED_TLDS)})$') THEN 'url/U4-suspicious-tld' END, CASE WHEN scheme = 'http' THEN 'url/U5-non-https' END] END, lambda x: x IS NOT NULL)) AS rule_id
FROM us WHERE host <> '' AND NOT allowed""")
def url_rules(spark, sf_dir):
    return scanned(spark, sf_dir, "malicious_urls").select("path", "line", "rule_id")


_FENCE = r"""
fs AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, sum(regexp_matches(line, '^\s*```')::INT) OVER (PARTITION BY path ORDER BY line_no) AS fences FROM tl WHERE ext = 'md'),
prose AS (SELECT * FROM fs WHERE NOT fence AND fences % 2 = 0)"""


@query(f"WITH {SAMPLE_LINES}, {_FENCE} SELECT path, line_no, NOT fence AND fences % 2 = 0 AS in_prose FROM fs")
def obfusc_fence_window(spark, sf_dir):
    return L.with_states(sample_lines(spark, sf_dir)).where("ext = 'md'").select("path", "line_no", "in_prose")


_TOKENS = rf"""
tk0 AS (SELECT path, line_no AS line, unnest(regexp_split_to_array(regexp_replace(regexp_replace(line, '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+')) AS t FROM prose WHERE NOT {IGNORED}),
tk AS (SELECT path, line, regexp_replace(t, '^[.,;:!?()\[\]"''*_]+|[.,;:!?()\[\]"''*_]+$', '', 'g') AS t FROM tk0),
cl AS (SELECT path, line, t, strlen(t) AS n, strlen(t) >= 60 AND regexp_matches(t, '^[A-Za-z0-9+/=-]+$') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9+/=]') AS b64,
         strlen(t) >= 40 AND regexp_matches(t, '^[0-9A-Fa-f]+$') AS hx, round(list_entropy(regexp_extract_all(hex(encode(t)), '..')), 6) AS bits FROM tk WHERE strlen(t) >= 40)"""


@query(f"""WITH {SAMPLE_LINES}, {_FENCE}, {_TOKENS} SELECT path, line, CASE WHEN b64 THEN 'obfusc/O1-base64' WHEN hx THEN 'obfusc/O2-hex-blob' ELSE 'obfusc/O3-high-entropy' END AS rule_id FROM cl WHERE b64 OR hx OR bits > 4.5""")
def obfusc_tokens(spark, sf_dir):
    return scanned(spark, sf_dir, "obfuscation").select("path", "line", "rule_id")


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) SELECT doc_id, max(round(list_entropy(regexp_extract_all(hex(encode(t)), '..')), 6)) AS entropy FROM w WHERE t <> '' GROUP BY doc_id")
def obfusc_entropy(spark, sf_dir):
    """Every word of every document, by its bytes."""
    w = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.split("text", " ")).alias("t"))
    return w.where("t <> ''").groupBy("doc_id").agg(F.max(F.round(X.entropy(F.col("t")), 6)).alias("entropy"))


_LOOK = "[" + "".join(map(chr, R.HOMOGLYPHS)) + "]"


@query(f"""WITH {SAMPLE_LINES}, {_FENCE}
SELECT path, line_no AS line, unnest(list_filter([CASE WHEN regexp_matches(line, '{L.TURNING}') THEN 'script/SM2-bidi-override' END, CASE WHEN regexp_matches(line, '{_LOOK}') THEN 'script/SM1-homoglyph' END], lambda x: x IS NOT NULL)) AS rule_id
FROM prose WHERE NOT {IGNORED} AND trim(line) <> '---'""")
def script_mixing_body(spark, sf_dir):
    return scanned(spark, sf_dir, "script_mixing").select("path", "line", "rule_id")


@query(f"""WITH v(name) AS (VALUES ('payрal'), ('αlpha'), ('plain'), ('ра'), ('a‮b'), ('café'))
SELECT name || o AS name, regexp_matches(name, '{_LOOK}') AS lookalike, regexp_matches(name, '{L.TURNING}') AS turning, regexp_matches(name || o, '{L.LATIN}') AND regexp_matches(name, '{L.CYRILLIC_OR_GREEK}') AS several
FROM v, (SELECT DISTINCT o_orderkey % 50 AS o FROM orders)""")
def script_mixed_fields(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("payрal", "αlpha", "plain", "ра", "a‮b", "café")], "name string")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("o")).distinct().join(F.broadcast(names), F.lit(True))
    has = lambda r: F.exists(L.script_hits(F.col("n"), True), lambda h: h["rule_id"] == r)
    return rows.select(F.concat("name", F.col("o").cast("string")).alias("n")).select(F.col("n").alias("name"), has("script/SM1-homoglyph").alias("lookalike"), has("script/SM2-bidi-override").alias("turning"), has("script/SM3-mixed-scripts").alias("several"))


# ---- personal data

_SOURCES = f"""{DOC_LINES}, {SAMPLE_LINES},
pl AS (SELECT 'doc_' || doc_id AS path, line_no, line FROM dl UNION ALL SELECT path, line_no, line FROM tl WHERE ext IN ('md', 'sh') AND NOT {IGNORED})"""
_LUHN = "(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT ELSE (2 * substr(reverse(d), i, 1)::INT) // 10 + (2 * substr(reverse(d), i, 1)::INT) % 10 END)) % 10 = 0)"


def pii_lines(spark, sf_dir) -> DataFrame:
    docs = document_lines(spark, sf_dir).select(F.regexp_replace("path", r"\.md$", "").alias("path"), "line_no", "line")
    return docs.unionByName(sample_lines(spark, sf_dir).where(F.col("ext").isin("md", "sh") & ~L.ignored(F.col("line"))).select("path", "line_no", "line"))


def matched(spark, sf_dir, pattern: str) -> DataFrame:
    return pii_lines(spark, sf_dir).select("path", "line_no", F.explode(X.every(F.col("line"), pattern)).alias("v"))


def _matched_sql(pattern: str) -> str:
    return f"WITH {_SOURCES}, m AS (SELECT path, line_no, unnest(regexp_extract_all(line, {quoted(pattern)})) AS v FROM pl)"


@query(_matched_sql(R.EMAIL) + f"""SELECT path, line_no, v AS address FROM m WHERE NOT (string_split(lower(v), '@')[-1] IN {_LISTED(R.EXAMPLE_DOMAINS)} OR regexp_matches(lower(v), '\\.(example|test|invalid|localhost)$') OR string_split(lower(v), '@')[1] IN {_LISTED(R.EXAMPLE_LOCALS)})""")
def pii_email(spark, sf_dir):
    return matched(spark, sf_dir, R.EMAIL).where(~L.example_email(F.col("v"))).withColumnRenamed("v", "address")


@query(_matched_sql(R.SSN) + r""", g AS (SELECT *, v[1:3]::INT AS a, v[5:6]::INT AS g, v[8:11]::INT AS s FROM m) SELECT path, line_no, v FROM g WHERE NOT (v = '123-45-6789' OR a IN (0, 666) OR a BETWEEN 900 AND 999 OR g = 0 OR s = 0)""")
def pii_ssn(spark, sf_dir):
    return matched(spark, sf_dir, R.SSN).where(~L.placeholder_ssn(F.col("v")))


@query(_matched_sql(R.CARD) + f""", d AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM m) SELECT path, line_no, d AS digits FROM d WHERE length(d) BETWEEN 13 AND 19 AND {_LUHN}""")
def pii_credit_card(spark, sf_dir):
    d = matched(spark, sf_dir, R.CARD).select("path", "line_no", L.card_digits(F.col("v")).alias("digits"))
    return d.where(F.length("digits").between(13, 19) & F.call_function("luhn_check", F.col("digits")))


@query(_matched_sql(R.IPV4) + """, o AS (SELECT *, list_transform(string_split(v, '.'), lambda x: x::INT) AS o FROM m)
SELECT path, line_no, v FROM o WHERE list_max(o) <= 255 AND (o[1] = 10 OR o[1] = 127 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254))""")
def pii_private_ipv4(spark, sf_dir):
    return matched(spark, sf_dir, R.IPV4).where(L.private_ipv4(F.col("v")))


@query(_matched_sql(R.INTERNAL_HOST) + "SELECT path, line_no, v FROM m")
def pii_internal_host(spark, sf_dir):
    return matched(spark, sf_dir, R.INTERNAL_HOST)


def _redact_sql(line: str) -> str:
    for p, mark in R.REDACTIONS:
        line = f"regexp_replace({line}, {quoted(p)}, {quoted(mark)}, 'g')"
    return line


@query(f"WITH {_SOURCES} SELECT path, line_no, md5({_redact_sql('line')}) AS redacted FROM pl")
def pii_redact(spark, sf_dir):
    return pii_lines(spark, sf_dir).select("path", "line_no", F.md5(L.redact(F.col("line")).cast("binary")).alias("redacted"))


# ---- filters


@query(f"WITH {SAMPLE_LINES} SELECT path, line_no, {COMMENT} AS comment, {IGNORED} AS ignored FROM tl WHERE ext = 'sh'")
def inline_suppress(spark, sf_dir):
    line = F.col("line")
    return sample_lines(spark, sf_dir).where("ext = 'sh'").select("path", "line_no", L.shell_comment(line).alias("comment"), L.ignored(line).alias("ignored"))


@query(f"WITH {SAMPLE_LINES} SELECT path, line_no, {ALL_ALLOWED} AS allowed FROM tl")
def bash_h1_allowlist_forall(spark, sf_dir):
    return sample_lines(spark, sf_dir).select("path", "line_no", X.all_hosts_allowed(F.col("line"), R.DOMAINS).alias("allowed"))


@query(f"""WITH v(stem) AS (VALUES ('LICENSE'), ('readme'), ('Changelog'), ('notes')) SELECT n_name || '-' || stem AS name, lower(stem) IN {_LISTED(R.BENIGN_STEMS)} AS benign FROM v, nation""")
def benign_files(spark, sf_dir):
    stems = spark.createDataFrame([(s,) for s in ("LICENSE", "readme", "Changelog", "notes")], "stem string")
    return table(spark, sf_dir, "nation").join(F.broadcast(stems), F.lit(True)).select(F.concat("n_name", F.lit("-"), "stem").alias("name"), F.lower("stem").isin(*R.BENIGN_STEMS).alias("benign"))


# ---- metadata


def _meta_sql(mode: str) -> str:
    samples = S.SKILLS if mode == "skill" else S.AGENTS
    return rf"""
mf AS (SELECT '{mode}-' || c_custkey AS artifact_id, string_split(replace(t, '{{k}}', c_custkey::VARCHAR), chr(10)) AS ls
  FROM customer JOIN ({values(enumerate(samples))}) s(i, t) ON c_custkey % {len(samples)} = i WHERE c_custkey % 11 <> 0),
ml AS (SELECT artifact_id, unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS line, unnest(range(1, len(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) + 1)) AS line_no FROM mf),
me AS (SELECT *, min(CASE WHEN line_no > 1 AND trim(line) = '---' THEN line_no END) OVER w AS en, bool_or(line_no = 1 AND trim(line) = '---') OVER w AS op FROM ml WINDOW w AS (PARTITION BY artifact_id)),
mh AS (SELECT artifact_id, line, line_no, regexp_matches(line, '^[^\s:][^:]*:') AS may FROM me WHERE op AND line_no > 1 AND (en IS NULL OR line_no < en) AND NOT regexp_matches(line, '^\s*#')),
mi AS (SELECT *, coalesce(sum(may::INT) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS seen FROM mh),
mj AS (SELECT *, regexp_matches(line, '^(  - |\t- )') OR (starts_with(line, '- ') AND seen) AS item FROM mi),
mk AS (SELECT *, CASE WHEN may AND NOT item THEN trim(string_split(line, ':')[1]) END AS key, CASE WHEN item THEN trim(regexp_replace(line, '^\s*- ', '')) WHEN may THEN trim(line[strpos(line, ':') + 1:]) END AS value FROM mj),
mm AS (SELECT *, last_value(key IGNORE NULLS) OVER w AS of_key, last_value(CASE WHEN key IS NOT NULL THEN value END IGNORE NULLS) OVER w AS of_value, last_value(CASE WHEN key IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS of_line FROM mk WINDOW w AS (PARTITION BY artifact_id ORDER BY line_no))"""


_FIELD = lambda k: f"max_by(value, line_no) FILTER (WHERE key = '{k}' AND value <> '') AS {k}, coalesce(max(line_no) FILTER (WHERE key = '{k}' AND value <> ''), 0) AS {k}_line"
_ITEMS = r"""CASE WHEN item THEN [value] WHEN value LIKE '[%]' THEN list_transform(regexp_extract_all(value[2:-2], '[^,(]+(?:\([^)]*\)[^,(]*)*'), lambda x: trim(x)) {plain} ELSE [] END"""
_SKILL_TOOLS = _ITEMS.format(plain=r"WHEN value <> '' THEN regexp_extract_all(value, '[^ (]+(?:\([^)]*\)[^ (]*)*')")
_BLOCKS = _LISTED(M.BLOCK_STARTS)
_AGENT_TOOLS = _ITEMS.format(plain=f"WHEN value NOT IN {_BLOCKS} THEN [value]")


@query(f"""WITH {_meta_sql("skill")}, tools AS (SELECT artifact_id, line_no, unnest({_SKILL_TOOLS}) AS tool FROM mm WHERE of_key = 'allowed-tools' AND (item OR key IS NOT NULL))
SELECT artifact_id, {_FIELD("name")}, {_FIELD("description")}, {_FIELD("compatibility")}, coalesce((SELECT count(*) FROM tools t WHERE t.artifact_id = mm.artifact_id AND tool <> ''), 0)::BIGINT AS n_tools FROM mm GROUP BY artifact_id""")
def fm_parse(spark, sf_dir):
    files, _ = metadata_files(spark, sf_dir, "skill")
    rows = M.parsed(Fs.lines_of(files), "skill")
    return rows.select("artifact_id", *(c for k in M.FIELDS["skill"] for c in (F.col(f"{k}.v").alias(k), F.coalesce(F.col(f"{k}.line"), F.lit(0)).alias(f"{k}_line"))), F.size("allowed_tools").cast("long").alias("n_tools"))


@query(f"""WITH {_meta_sql("skill")} SELECT artifact_id, line_no, tool FROM (SELECT artifact_id, line_no, unnest({_SKILL_TOOLS}) AS tool FROM mm WHERE of_key = 'allowed-tools' AND (item OR key IS NOT NULL)) WHERE tool <> ''""")
def fm_tools_explode(spark, sf_dir):
    files, _ = metadata_files(spark, sf_dir, "skill")
    return M.parsed(Fs.lines_of(files), "skill").select("artifact_id", F.explode("allowed_tools").alias("t")).select("artifact_id", F.col("t.line").alias("line_no"), F.col("t.v").alias("tool"))


@query(f"""WITH {_meta_sql("agent")}, sp AS (SELECT artifact_id, max(line_no) AS sp_line, max_by(value, line_no) AS first FROM mm WHERE key = 'system-prompt' GROUP BY artifact_id),
bl AS (SELECT mm.artifact_id, string_agg(chr(10) || ltrim(line), '' ORDER BY line_no) AS rest FROM mm JOIN sp ON mm.artifact_id = sp.artifact_id AND of_line = sp_line WHERE of_key = 'system-prompt' AND of_value IN {_BLOCKS} AND NOT item AND NOT may AND regexp_matches(line, '^(  |\t)') GROUP BY mm.artifact_id)
SELECT artifact_id, {_FIELD("name")}, {_FIELD("model")}, any_value(CASE WHEN first IN {_BLOCKS} THEN coalesce(rest, '') ELSE first END) AS system_prompt,
  list_sum(list(CASE WHEN of_key = 'tools' AND (item OR key IS NOT NULL) THEN len({_AGENT_TOOLS}) ELSE 0 END))::BIGINT AS n_tools,
  list_sum(list(CASE WHEN of_key = 'mcp-servers' AND (item OR key IS NOT NULL) THEN len({_AGENT_TOOLS}) ELSE 0 END))::BIGINT AS n_servers
FROM mm LEFT JOIN sp USING (artifact_id) LEFT JOIN bl USING (artifact_id) GROUP BY artifact_id""")
def agent_parse(spark, sf_dir):
    files, _ = metadata_files(spark, sf_dir, "agent")
    rows = M.parsed(Fs.lines_of(files), "agent")
    return rows.select("artifact_id", *(c for k in ("name", "model") for c in (F.col(f"{k}.v").alias(k), F.coalesce(F.col(f"{k}.line"), F.lit(0)).alias(f"{k}_line"))), F.col("system_prompt.v").alias("system_prompt"), F.size("tools").cast("long").alias("n_tools"), F.size("mcp_servers").cast("long").alias("n_servers"))


def metadata_findings(spark, sf_dir, mode: str) -> DataFrame:
    files, artifacts = metadata_files(spark, sf_dir, mode)
    return M.scan_metadata(files, Fs.lines_of(files), artifacts, mode)


def _fm_rules_sql(mode: str) -> str:
    p, sentinel = M.PREFIX[mode], Fs.SENTINELS[mode]
    vague = "|".join(R.VAGUE_NAMES)
    triggers = " OR ".join(f"contains(lower(description), {quoted(t)})" for t in R.TRIGGERS)
    tools_key, tools = ("allowed-tools", _SKILL_TOOLS) if mode == "skill" else ("tools", _AGENT_TOOLS)
    bare = "bare-bash-tool" if mode == "skill" else "bare-tool"
    extra = "" if mode == "skill" else f"""
  UNION ALL SELECT artifact_id, 'agent/unconstrained-mcp-server' FROM (SELECT artifact_id, unnest({_AGENT_TOOLS}) AS tool FROM mm WHERE of_key = 'mcp-servers' AND (item OR key IS NOT NULL)) WHERE tool <> '' AND NOT contains(tool, '(')
  UNION ALL SELECT artifact_id, 'agent/model-not-specified' FROM heads WHERE artifact_id NOT IN (SELECT artifact_id FROM mm WHERE key = 'model' AND value <> '')
  UNION ALL SELECT artifact_id, 'agent/system-prompt-injection' FROM prompts WHERE regexp_matches(t, {quoted(R.SYSTEM_INJECTION)})
  UNION ALL SELECT artifact_id, 'agent/xml-in-frontmatter' FROM prompts WHERE regexp_matches(t, '[<>]|&lt;|&gt;|&#')"""
    prompts = "" if mode == "skill" else f""", sp AS (SELECT artifact_id, max(line_no) AS sp_line, max_by(value, line_no) AS first FROM mm WHERE key = 'system-prompt' GROUP BY artifact_id),
prompts AS (SELECT sp.artifact_id, CASE WHEN any_value(first) IN {_BLOCKS} THEN coalesce(string_agg(chr(10) || ltrim(line), '' ORDER BY line_no) FILTER (WHERE of_line = sp_line AND NOT item AND NOT may AND regexp_matches(line, '^(  |\t)')), '') ELSE any_value(first) END AS t FROM sp JOIN mm USING (artifact_id) GROUP BY sp.artifact_id)"""
    return f"""WITH {_meta_sql(mode)},
heads AS (SELECT DISTINCT artifact_id FROM me WHERE op),
fields AS (SELECT artifact_id, max_by(value, line_no) FILTER (WHERE key = 'name' AND value <> '') AS name, max_by(value, line_no) FILTER (WHERE key = 'description' AND value <> '') AS description FROM mm GROUP BY artifact_id),
fl AS (SELECT f.artifact_id, name, description FROM (SELECT artifact_id FROM mf) f LEFT JOIN fields USING (artifact_id)){prompts},
found AS (
  SELECT artifact_id, unnest(list_filter([
    CASE WHEN regexp_matches(name, '[<>]|&lt;|&gt;|&#') THEN '{p}/xml-in-frontmatter' END,
    CASE WHEN regexp_matches(lower(name), 'claude|anthropic') THEN '{p}/name-reserved-word' END,
    CASE WHEN regexp_matches(name, '[\\p{{Lu}} _]') THEN '{p}/invalid-name-format' END,
    CASE WHEN length(name) > 64 THEN '{p}/name-too-long' END,
    CASE WHEN regexp_matches(name, '^-|-$') THEN '{p}/name-leading-trailing-hyphen' END,
    CASE WHEN contains(name, '--') THEN '{p}/name-consecutive-hyphens' END,
    CASE WHEN regexp_matches(lower(name), '(^|-)({vague})(-|$)') THEN '{p}/name-too-vague' END,
    CASE WHEN NOT regexp_matches(name, '[\\p{{Lu}} _]') AND name <> artifact_id THEN '{p}/name-directory-mismatch' END,
    CASE WHEN description IS NULL THEN '{p}/description-missing' END,
    CASE WHEN regexp_matches(description, '[<>]|&lt;|&gt;|&#') THEN '{p}/xml-in-frontmatter' END,
    CASE WHEN length(description) > 1024 THEN '{p}/description-too-long' END,
    CASE WHEN regexp_matches(description, {quoted(R.FIRST_PERSON)}) THEN '{p}/description-not-third-person' END,
    CASE WHEN description IS NOT NULL AND NOT ({triggers}) THEN '{p}/description-no-trigger' END], lambda x: x IS NOT NULL)) AS rule_id FROM fl
  UNION ALL SELECT artifact_id, '{p}/{bare}' FROM (SELECT artifact_id, unnest({tools}) AS tool FROM mm WHERE of_key = '{tools_key}' AND (item OR key IS NOT NULL)) WHERE lower(trim(tool)) = 'bash'
  UNION ALL SELECT artifact_id, '{p}/windows-path' FROM ml WHERE regexp_matches(line, {quoted(R.WINDOWS_PATH)}) GROUP BY artifact_id
  UNION ALL SELECT artifact_id, '{p}/time-sensitive-content' FROM ml WHERE regexp_matches(line, {quoted(R.TIME)}) GROUP BY artifact_id
  UNION ALL SELECT '{mode}-' || c_custkey, '{p}/missing-{sentinel.lower().replace(".", "-")}' FROM customer WHERE c_custkey % 11 = 0{extra}
  {"UNION ALL SELECT 'skill-' || c_custkey, 'frontmatter/readme-in-skill' FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0" if mode == "skill" else ""}
) SELECT artifact_id, rule_id, count(*) AS n FROM found GROUP BY ALL"""


@query(_fm_rules_sql("skill"))
def fm_rules(spark, sf_dir):
    return metadata_findings(spark, sf_dir, "skill").groupBy("artifact_id", "rule_id").agg(F.count("*").alias("n"))


@query(_fm_rules_sql("agent"))
def agent_rules(spark, sf_dir):
    return metadata_findings(spark, sf_dir, "agent").groupBy("artifact_id", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_meta_sql("skill")} SELECT artifact_id, count(*) AS n_lines, coalesce(min(line_no) FILTER (WHERE regexp_matches(line, {quoted(R.WINDOWS_PATH)})), 0) AS windows, coalesce(min(line_no) FILTER (WHERE regexp_matches(line, {quoted(R.TIME)})), 0) AS dated FROM ml GROUP BY artifact_id""")
def fm_first_hit_line(spark, sf_dir):
    files, _ = metadata_files(spark, sf_dir, "skill")
    return M.body(Fs.lines_of(files), "skill").select("artifact_id", "n_lines", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("dated", F.lit(0)).alias("dated"))


@query("SELECT 'skill-' || c_custkey AS artifact_id FROM customer WHERE c_custkey % 11 = 0")
def fm_missing_anti_join(spark, sf_dir):
    return metadata_findings(spark, sf_dir, "skill").where("rule_id = 'frontmatter/missing-skill-md'").select("artifact_id")


# ---- findings to reports: the bash, typescript and prompt scanners over the samples, with suppressions

_BASIC = ("bash_patterns", "typescript_patterns", "prompt")
_RULES_SQL = values((i, r.id, r.severity, r.scanner, r.message, r.remediation) for i, r in enumerate((*R.ALL, *R.READ_ERRORS)))


def _union_sql() -> str:
    part = lambda name: SQL[name].split("\nSELECT", 1)[1]
    parts = " UNION ALL ".join(f"SELECT {part(n)}" for n in ("bash_multi_match", "ts_multi_match", "prompt_multi_match"))
    return f"{SAMPLE_LINES}, fd0 AS ({parts}), rl(rule_ord, rule_id, severity, scanner, message, remediation) AS ({_RULES_SQL}), fd AS (SELECT string_split(path, '/')[1] AS artifact_id, path, line, rule_id, severity, scanner, rule_ord FROM fd0 JOIN rl USING (rule_id))"


_SUPP = f"""sp(ordinal, rule, file, lines, reason) AS ({values((i, *s) for i, s in enumerate(S.SUPPRESSIONS))}),
sq AS (SELECT *, CASE WHEN regexp_matches(lines, '^[0-9]+$') THEN lines::BIGINT WHEN regexp_matches(lines, '^[0-9]+-[0-9]+$') THEN string_split(lines, '-')[1]::BIGINT END AS b, CASE WHEN regexp_matches(lines, '^[0-9]+$') THEN lines::BIGINT WHEN regexp_matches(lines, '^[0-9]+-[0-9]+$') THEN string_split(lines, '-')[2]::BIGINT END AS e, regexp_replace(file, '^\\./', '') AS f FROM sp),
fs AS (SELECT fd.*, (SELECT min_by(reason, ordinal) FROM sq WHERE rule = fd.rule_id AND (f = '' OR fd.path = f OR ends_with(fd.path, '/' || f)) AND (lines IS NULL OR (b <= e AND fd.line BETWEEN b AND e))) AS reason FROM fd)"""


def sample_findings(spark, sf_dir) -> DataFrame:
    found = A.with_rules(scanned(spark, sf_dir, *_BASIC)).withColumn("column", F.lit(None).cast("long"))
    entries = spark.createDataFrame([(i, *s, None) for i, s in enumerate(S.SUPPRESSIONS)], "ordinal int, rule string, file string, lines string, reason string, ticket string")
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("artifact_id")).distinct()
    return A.suppress(found, ids.join(F.broadcast(entries), F.lit(True)))


def sample_artifacts(spark, sf_dir) -> DataFrame:
    """Some artifacts have no finding at all."""
    ids = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), (F.col("c_custkey") % 50).cast("string")).alias("artifact_id")).distinct()
    return ids.withColumn("name", F.col("artifact_id"))


def _deferred(name: str, sql: Callable[[], str]):
    SQL[name] = sql()


@query()
def suppress_join(spark, sf_dir):
    return sample_findings(spark, sf_dir).select("path", "line", "rule_id", "suppressed", "suppression_reason")


_deferred("suppress_join", lambda: f"WITH {_union_sql()}, {_SUPP} SELECT path, line, rule_id, reason IS NOT NULL AS suppressed, reason AS suppression_reason FROM fs")

_CRIT = f"regexp_matches(rule_id, {quoted(A.CRITICAL)})"
_COUNTS = f"""ct AS (SELECT artifact_id, count(*) FILTER (WHERE severity = 'error' AND reason IS NULL) AS errors, count(*) FILTER (WHERE severity = 'warning' AND reason IS NULL) AS warnings, count(*) FILTER (WHERE severity = 'info' AND reason IS NULL) AS info, count(*) FILTER (WHERE reason IS NOT NULL) AS suppressed,
  coalesce(sum(CASE severity WHEN 'error' THEN CASE WHEN {_CRIT} THEN 30 ELSE 15 END WHEN 'warning' THEN 5 ELSE 1 END) FILTER (WHERE reason IS NULL), 0) AS cost, count(*) FILTER (WHERE severity = 'error' AND {_CRIT} AND reason IS NULL) AS critical FROM fs GROUP BY artifact_id),
rp AS (SELECT artifact_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(info, 0) AS info, coalesce(suppressed, 0) AS suppressed, greatest(0, 100 - coalesce(cost, 0))::INT AS security_score, coalesce(critical, 0) AS critical FROM (SELECT DISTINCT 'a' || (c_custkey % 50) AS artifact_id FROM customer) LEFT JOIN ct USING (artifact_id)),
rr AS (SELECT artifact_id, errors, warnings, info, suppressed, security_score, CASE WHEN security_score >= 90 THEN 'A' WHEN security_score >= 75 THEN 'B' WHEN security_score >= 60 THEN 'C' WHEN security_score >= 40 THEN 'D' ELSE 'F' END AS security_grade,
  CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END AS status, CASE WHEN critical > 0 THEN 'critical' WHEN errors > 0 THEN 'high' WHEN warnings > 0 THEN 'medium' ELSE 'low' END AS risk_level, errors = 0 AND warnings = 0 AS passed FROM rp)"""
_REPORTS = f"WITH {_union_sql()}, {_SUPP}, {_COUNTS}"


def sample_reports(spark, sf_dir) -> DataFrame:
    return A.artifact_reports(sample_artifacts(spark, sf_dir), sample_findings(spark, sf_dir))


@query(f"{_REPORTS} SELECT artifact_id, errors, warnings, info, suppressed FROM rr")
def severity_counts(spark, sf_dir):
    return sample_reports(spark, sf_dir).select("artifact_id", "errors", "warnings", "info", "suppressed")


@query(f"{_REPORTS} SELECT artifact_id, security_score, security_grade FROM rr")
def score_grade(spark, sf_dir):
    return sample_reports(spark, sf_dir).select("artifact_id", "security_score", "security_grade")


@query(f"{_REPORTS} SELECT artifact_id, status, risk_level, passed FROM rr")
def status_risk(spark, sf_dir):
    return sample_reports(spark, sf_dir).select("artifact_id", "status", "risk_level", "passed")


@query(f"{_REPORTS} SELECT count(*) AS artifacts, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'warning') AS warned, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE security_score < 60) AS below_min, bool_and(passed AND security_score >= 60) AS gate FROM rr")
def collection_summary(spark, sf_dir):
    return A.collection_totals(sample_reports(spark, sf_dir), 60)


@query(f"WITH {_union_sql()}, c AS (SELECT artifact_id, scanner, count(*) AS findings, sum(CASE severity WHEN 'error' THEN CASE WHEN {_CRIT} THEN 30 ELSE 15 END WHEN 'warning' THEN 5 ELSE 1 END) AS cost FROM fd GROUP BY ALL) SELECT artifact_id, scanner, findings, greatest(0, 100 - cost)::INT AS scanner_score FROM c")
def scanner_scores(spark, sf_dir):
    found = sample_findings(spark, sf_dir)
    results = found.select("artifact_id", "scanner").distinct().withColumns({"skipped": F.lit(False), "error": F.lit(None).cast("string")})
    return A.scanner_reports(results, found).select("artifact_id", "scanner", "findings", "scanner_score")


@query(f"WITH {_union_sql()} SELECT scanner, rule_id, count(*) AS n FROM fd GROUP BY ROLLUP (scanner, rule_id)")
def rule_rollup(spark, sf_dir):
    return A.rule_totals(sample_findings(spark, sf_dir))


_PLACE = "list_position([" + ", ".join(map(quoted, R.ORDER["skill"])) + "], scanner)"


@query(f"WITH {_union_sql()} SELECT path, line, rule_id, (row_number() OVER (PARTITION BY artifact_id ORDER BY {_PLACE}, path, line, rule_ord) - 1)::INT AS ordinal FROM fd")
def findings_sorted(spark, sf_dir):
    return A.ordered(sample_findings(spark, sf_dir)).select("path", "line", "rule_id", "ordinal")


@query(f"WITH {_union_sql()} SELECT artifact_id, rule_id, (dense_rank() OVER (PARTITION BY artifact_id ORDER BY rule_id) - 1)::BIGINT AS rule_index FROM (SELECT DISTINCT artifact_id, rule_id FROM fd)")
def sarif_rule_index(spark, sf_dir):
    return O.sarif_rules(sample_findings(spark, sf_dir)).select("artifact_id", "rule_id", "rule_index")


@query(f"WITH {_union_sql()} SELECT artifact_id, path AS uri, line AS start_line, rule_id, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, (dense_rank() OVER (PARTITION BY artifact_id ORDER BY rule_id) - 1)::BIGINT AS rule_index FROM fd")
def sarif_results(spark, sf_dir):
    return O.sarif_results(sample_findings(spark, sf_dir)).select("artifact_id", "uri", "start_line", "rule_id", "level", "rule_index")


@query(f"{_REPORTS} SELECT artifact_id, errors, warnings, suppressed, errors + warnings + info AS n_findings FROM rr")
def json_report(spark, sf_dir):
    found = sample_findings(spark, sf_dir)
    j = O.json_reports(sample_reports(spark, sf_dir), found)
    n = lambda p: F.get_json_object("json", p).cast("long")
    return j.select("artifact_id", n("$.summary.errors").alias("errors"), n("$.summary.warnings").alias("warnings"), n("$.summary.suppressed").alias("suppressed"), F.json_array_length(F.get_json_object("json", "$.findings")).cast("long").alias("n_findings"))


@query(f"{_REPORTS} SELECT sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings FROM rr")
def count_rollup(spark, sf_dir):
    return O.summed_counts(O.json_reports(sample_reports(spark, sf_dir), sample_findings(spark, sf_dir)))


@query(f"{_REPORTS} SELECT artifact_id, security_score, (errors + warnings + info + suppressed) AS n_results FROM rr")
def sarif_runs(spark, sf_dir):
    r = O.sarif_runs(sample_reports(spark, sf_dir), sample_findings(spark, sf_dir))
    return r.select("artifact_id", F.get_json_object("run", "$.properties.security_score").cast("int").alias("security_score"), F.json_array_length(F.get_json_object("run", "$.results")).cast("long").alias("n_results"))


@query(f"SELECT rule_ord, rule_id, severity, scanner FROM ({_RULES_SQL}) t(rule_ord, rule_id, severity, scanner, message, remediation)")
def rule_catalogue(spark, sf_dir):
    return A.catalogue(spark).select("rule_ord", "rule_id", "severity", "scanner")


@query(f"SELECT rule_id, message, remediation FROM ({_RULES_SQL}) t(rule_ord, rule_id, severity, scanner, message, remediation) WHERE rule_id = 'bash/CAT-A1'")
def explain_rule(spark, sf_dir):
    return A.catalogue(spark).where("rule_id = 'bash/CAT-A1'").select("rule_id", F.col("rule_message").alias("message"), "remediation").limit(1)


_RANGES = ("5", "1-9", "9-1", "1-2-3", " 5", "", "x", "7-", "0-0", "12-12000")


@query(f"""WITH v(r) AS ({values((r,) for r in _RANGES)}), g AS (SELECT o_orderkey, r, regexp_matches(r, '^[0-9]+$') AS one, regexp_matches(r, '^[0-9]+-[0-9]+$') AS two FROM v, orders)
SELECT o_orderkey, r, coalesce(CASE WHEN one THEN r::BIGINT = o_orderkey WHEN two AND string_split(r, '-')[1]::BIGINT <= string_split(r, '-')[2]::BIGINT THEN o_orderkey BETWEEN string_split(r, '-')[1]::BIGINT AND string_split(r, '-')[2]::BIGINT END, false) AS fits FROM g""")
def suppress_line_range(spark, sf_dir):
    """Each of the ranges over all orders."""
    ranges = spark.createDataFrame([(r,) for r in _RANGES], "r string")
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(ranges), F.lit(True))
    begin, end, valid = A.line_range(F.col("r"))
    return o.select("o_orderkey", "r", F.coalesce(valid & F.col("o_orderkey").between(begin, end), F.lit(False)).alias("fits"))


_KINDS = {"skill": (*R.COMMON, *R.FRONTMATTER), "agent": (*R.COMMON, *R.AGENT)}


@query(f"""WITH s(id, sev) AS ({values((r.id, r.severity) for r in _KINDS["skill"])}), a(id, sev) AS ({values((r.id, r.severity) for r in _KINDS["agent"])})
SELECT id AS rule_id, sev AS severity FROM s UNION ALL SELECT id, sev FROM a WHERE id NOT IN (SELECT id FROM s)""")
def rule_catalogue_union(spark, sf_dir):
    skill, agent = (A.catalogue(spark, _KINDS[k]).select("rule_id", "severity") for k in ("skill", "agent"))
    return skill.unionByName(agent.join(skill, "rule_id", "left_anti"))


@query(f"WITH {_union_sql()} SELECT path, line, rule_id, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM fd")
def severity_ranks(spark, sf_dir):
    return A.ordered(sample_findings(spark, sf_dir)).select("path", "line", "rule_id", A.severity_rank(F.col("severity")).alias("rank"))


_READ = f"""fx AS (SELECT DISTINCT artifact_id, path, ext FROM tl)"""


@query(f"WITH {SAMPLE_LINES}, {_READ} SELECT artifact_id, sum(CASE ext WHEN 'sh' THEN 4 WHEN 'md' THEN 5 ELSE 1 END)::BIGINT AS files_scanned FROM fx GROUP BY artifact_id")
def files_scanned_sum(spark, sf_dir):
    from lynceus.plans.engine import scanner_results

    files = sample_lines(spark, sf_dir).select("artifact_id", "path", "file_name", "ext", "ext_raw", "stem").distinct().withColumns({"rel_path": F.col("file_name"), "read_error": F.lit(None).cast("string")})
    return scanner_results(files, files.select("artifact_id").distinct(), "skill", Config()).groupBy("artifact_id").agg(F.sum("files_scanned").alias("files_scanned"))


# ---- external tools


def tool_outputs(spark, sf_dir, sample: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = F.replace(F.lit(sample), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    return s.select(F.col("s_suppkey").cast("string").alias("artifact_id"), F.when(F.col("s_suppkey") % 10 == 0, F.lit("not json")).when(F.col("s_suppkey") % 10 == 1, F.lit(" ")).otherwise(text).alias("stdout"))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 NOT IN (0, 1))
SELECT k::VARCHAR AS artifact_id, 'a' || k || '.sh' AS path, k::BIGINT AS line, 3::BIGINT AS "column", 'shellcheck/SC2086' AS rule_id, 'info' AS severity, '"x"' AS snippet FROM s
UNION ALL SELECT k::VARCHAR, 'b.sh', 2, 1, 'shellcheck/SC1000', 'error', NULL FROM s""")
def shellcheck_ingest(spark, sf_dir):
    return external.shellcheck(tool_outputs(spark, sf_dir, S.SHELLCHECK_JSON)).select("artifact_id", "path", "line", "column", "rule_id", "severity", "snippet")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 NOT IN (0, 1))
SELECT k::VARCHAR AS artifact_id, 'a.py' AS path, k::BIGINT AS line, 'semgrep/r.' || k AS rule_id, 'error' AS severity, 'x = 1' AS snippet, 'f' AS remediation FROM s
UNION ALL SELECT k::VARCHAR, 'a.py', 1, 'semgrep/q', 'info', 'y', NULL FROM s""")
def semgrep_ingest(spark, sf_dir):
    return external.semgrep(tool_outputs(spark, sf_dir, S.SEMGREP_JSON)).select("artifact_id", "path", "line", "rule_id", "severity", "snippet", "remediation")


@query("SELECT s_suppkey::VARCHAR AS artifact_id, CASE WHEN s_suppkey % 10 IN (0, 1) THEN 0 ELSE 1 END::BIGINT AS files_scanned FROM supplier")
def semgrep_files(spark, sf_dir):
    return external.semgrep_files(tool_outputs(spark, sf_dir, S.SEMGREP_JSON))


@query("SELECT s_suppkey::VARCHAR AS artifact_id, CASE WHEN s_suppkey % 10 = 0 THEN 'output is not JSON' END AS error FROM supplier")
def tool_errors(spark, sf_dir):
    return external.parsed(tool_outputs(spark, sf_dir, S.SHELLCHECK_JSON), external.SHELLCHECK).select("artifact_id", "error")


# ---- all together


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade of every document for personal data."""
    files = document_files(spark, sf_dir)
    found = A.with_rules(L.scan_lines(Fs.lines_of(files), only("pii"))).withColumn("suppressed", F.lit(False))
    reports = A.artifact_reports(files.select("artifact_id").distinct(), found)
    return reports.select("artifact_id", "errors", "warnings", "info", "security_score", "security_grade", "status")


def _flag_sql() -> str:
    parts = []
    for name, rule, sev in (("pii_email", "P1", "warning"), ("pii_ssn", "P2", "error"), ("pii_credit_card", "P3", "error"), ("pii_private_ipv4", "P4", "info"), ("pii_internal_host", "P5", "warning")):
        body = SQL[name].replace("'doc_' || doc_id AS path", "doc_id::VARCHAR AS path")
        parts.append(f"SELECT path AS artifact_id, '{sev}' AS severity FROM ({body})")
    return f"""WITH f AS ({" UNION ALL ".join(parts)}), c AS (SELECT artifact_id, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'info') AS i FROM f GROUP BY artifact_id),
r AS (SELECT doc_id::VARCHAR AS artifact_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS info FROM documents LEFT JOIN c ON artifact_id = doc_id::VARCHAR), s AS (SELECT *, greatest(0, 100 - 15 * errors - 5 * warnings - info)::INT AS security_score FROM r)
SELECT artifact_id, errors, warnings, info, security_score, CASE WHEN security_score >= 90 THEN 'A' WHEN security_score >= 75 THEN 'B' WHEN security_score >= 60 THEN 'C' WHEN security_score >= 40 THEN 'D' ELSE 'F' END AS security_grade, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END AS status FROM s"""


QUERIES["pii_flagship"] = flagship
SQL["pii_flagship"] = _flag_sql()


_AUDIT_LINES = r"""
al0 AS (SELECT 'page_' || page_id AS artifact_id, concat_ws(chr(10), url, html) AS text FROM pages UNION ALL SELECT 'doc_' || doc_id, text FROM documents),
al1 AS (SELECT artifact_id, string_split(regexp_replace(text, '\r\n', chr(10), 'g'), chr(10)) AS ls FROM al0 WHERE text IS NOT NULL),
al2 AS (SELECT artifact_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM al1),
tl AS (SELECT artifact_id, artifact_id || '.md' AS path, 'md' AS ext, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM al2)"""


def _audit_sql() -> str:
    """The SQL of the scanners that read Markdown, over pages and documents; their rows are findings."""
    body = lambda name, start: SQL[name][SQL[name].rindex(start) :]
    tests = ", ".join(f"CASE WHEN regexp_matches(line, {quoted(r.pattern)}) THEN {quoted(r.id)} END" for r in R.PROMPT)
    kinds = (("pii_email", R.EMAIL, R.PII[0]), ("pii_ssn", R.SSN, R.PII[1]), ("pii_credit_card", R.CARD, R.PII[2]), ("pii_private_ipv4", R.IPV4, R.PII[3]), ("pii_internal_host", R.INTERNAL_HOST, R.PII[4]))
    parts = [
        f"SELECT path, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS rule_id FROM tl",
        f"SELECT path, rule_id FROM ({body('url_rules', 'SELECT path, line, unnest')})",
        f"SELECT path, rule_id FROM ({body('obfusc_tokens', 'SELECT path, line, CASE')})",
        f"SELECT path, rule_id FROM ({body('script_mixing_body', 'SELECT path, line_no')})",
        "SELECT artifact_id || '.md' AS path, 'frontmatter/missing-skill-md' FROM al0",
    ]
    for name, pattern, rule in kinds:
        rest = SQL[name].removeprefix(_matched_sql(pattern)).lstrip(" ,\n")
        found = f"m AS (SELECT path, line_no, unnest(regexp_extract_all(line, {quoted(pattern)})) AS v FROM tl WHERE NOT {IGNORED})"
        parts.append(f"SELECT path, '{rule.id}' FROM (WITH {found}{', ' if not rest.startswith('SELECT') else ' '}{rest})")
    return f"""WITH {_AUDIT_LINES}, {_URL_SQL}, {_FENCE}, {_TOKENS}, fd(path, rule_id) AS ({" UNION ALL ".join(parts)}),
rl(rule_ord, rule_id, severity, scanner, message, remediation) AS ({_RULES_SQL}),
c AS (SELECT path, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'info') AS i,
  sum(CASE severity WHEN 'error' THEN CASE WHEN regexp_matches(rule_id, '{A.CRITICAL}') THEN 30 ELSE 15 END WHEN 'warning' THEN 5 ELSE 1 END) AS cost FROM fd JOIN rl USING (rule_id) GROUP BY path),
r AS (SELECT artifact_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS info, greatest(0, 100 - coalesce(cost, 0))::INT AS security_score FROM al0 LEFT JOIN c ON path = artifact_id || '.md')
SELECT artifact_id, errors, warnings, info, security_score, CASE WHEN security_score >= 90 THEN 'A' WHEN security_score >= 75 THEN 'B' WHEN security_score >= 60 THEN 'C' WHEN security_score >= 40 THEN 'D' ELSE 'F' END AS security_grade,
  CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'warning' ELSE 'passed' END AS status, 5::BIGINT AS files_scanned FROM r"""


@query(_audit_sql())
def full_audit(spark, sf_dir):
    """All scanners over pages and documents as files of one artifact each, none of which has a metadata file."""
    p = spread(table(spark, sf_dir, "pages"))
    pages = Fs.from_rows(p, F.concat(F.lit("page_"), F.col("page_id").cast("string")), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".md")), F.concat_ws("\n", "url", "html"))
    files = pages.unionByName(document_files(spark, sf_dir).withColumn("artifact_id", F.concat(F.lit("doc_"), "artifact_id")))
    artifacts = files.select("artifact_id").distinct().withColumn("name", F.col("artifact_id"))
    return audit(files, artifacts, "skill").reports.select("artifact_id", "errors", "warnings", "info", "security_score", "security_grade", "status", "files_scanned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
