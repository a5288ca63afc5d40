"""Metadata heads of SKILL.md and AGENT.md, and the rules on them.

A head is a run of lines between two `---`. What a line means depends on the lines before it (the
last key, an open block), so lines of the sentinel files go through windows over their file. Each
file then folds into one row of fields, on which every rule is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.functions import text as X
from lynceus.rules import catalogue as R
from lynceus.sources.files import SENTINELS

SCANNER = {"skill": "frontmatter", "agent": "agent_frontmatter"}
RULES = {"skill": R.FRONTMATTER, "agent": R.AGENT}
PREFIX = {"skill": "frontmatter", "agent": "agent"}
LIST_KEYS = {"skill": ("allowed-tools",), "agent": ("tools", "mcp-servers")}
FIELDS = {"skill": ("name", "description", "compatibility"), "agent": ("name", "description", "model")}
KEY_VALUE = r"\A([^\s:][^:]*):(?s:(.*))\z"
BLOCK_STARTS = ("", "|", ">", "|-", ">-", "|+", ">+")


def head_lines(lines: DataFrame, mode: str) -> DataFrame:
    """Lines of heads with kind (key or item), key, value, and the key that an item or a block line belongs to."""
    file = Window.partitionBy("artifact_id", "path")
    order = file.orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = lines.where(F.col("file_name") == SENTINELS[mode]).withColumn("bare", X.trim(F.col("line")))
    end = F.min(F.when((F.col("line_no") > 1) & (F.col("bare") == "---"), F.col("line_no"))).over(file)
    opened = F.min(F.when((F.col("line_no") == 1) & (F.col("bare") == "---"), F.lit(1))).over(file) == 1
    head = own.withColumns({"_end": end, "_open": opened}).where(F.col("_open") & (F.col("line_no") > 1) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))) & ~F.col("bare").startswith("#"))
    may_be_key = X.matches(F.col("line"), KEY_VALUE)
    head = head.withColumn("_may", may_be_key.cast("int")).withColumn("_seen", F.coalesce(F.sum("_may").over(before), F.lit(0)) > 0)
    line = F.col("line")
    item = line.startswith("  - ") | line.startswith("\t- ") | (line.startswith("- ") & F.col("_seen"))
    head = head.withColumn("kind", F.when(item, F.lit("item")).when(F.col("_may") == 1, F.lit("key")))
    key = F.when(F.col("kind") == "key", X.trim(F.regexp_extract("line", X.rx(KEY_VALUE), 1)))
    value = F.when(F.col("kind") == "key", X.trim(F.regexp_extract("line", X.rx(KEY_VALUE), 2))).when(F.col("kind") == "item", X.trim(F.regexp_replace("line", X.rx(r"\A\s*- "), "")))
    head = head.withColumns({"key": key, "value": value})
    return head.withColumns({"of_key": F.last("key", ignorenulls=True).over(order), "of_line": F.last(F.when(F.col("key").isNotNull(), F.col("line_no")), ignorenulls=True).over(order), "of_value": F.last(F.when(F.col("key").isNotNull(), F.col("value")), ignorenulls=True).over(order)})


def listed(mode: str) -> Column:
    """The entries that a head line adds to a list: an item, or what a key's value lists."""
    value = F.col("value")
    flow = (F.length(value) >= 2) & value.startswith("[") & value.endswith("]")
    inner = F.filter(X.split_outside_parens(F.expr("substring(value, 2, length(value) - 2)"), ","), lambda t: t != "")
    plain = F.filter(X.split_outside_parens(value, " "), lambda t: t != "") if mode == "skill" else F.when(~value.isin(*BLOCK_STARTS), F.array(value)).otherwise(F.array().cast("array<string>"))
    by_key = F.when(flow, inner).when(value != "", plain).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("kind") == "item", F.filter(F.array(value), lambda t: t != "")).when(F.col("kind") == "key", by_key)


def parsed(lines: DataFrame, mode: str) -> DataFrame:
    """A row for each head: name, description and so on as struct v, line (null if absent), lists as arrays of the same."""
    head = head_lines(lines, mode)
    is_key = F.col("kind") == "key"
    last = lambda k: F.max(F.when(is_key & (F.col("key") == k) & (F.col("value") != ""), F.struct(F.col("line_no").alias("line"), F.col("value").alias("v"))))
    folded = [last(k).alias(k) for k in FIELDS[mode]]
    entry = F.transform(listed(mode), lambda t: F.struct(F.col("line_no").alias("line"), t.alias("v")))
    for k in LIST_KEYS[mode]:
        mine = F.when(F.col("kind").isNotNull() & (F.col("of_key") == k), F.struct(F.col("line_no"), entry.alias("e")))
        folded.append(F.flatten(F.transform(F.array_sort(F.collect_list(mine)), lambda s: s["e"])).alias(k.replace("-", "_")))
    if mode == "agent":
        prompt = F.max(F.when(is_key & (F.col("key") == "system-prompt"), F.struct(F.col("line_no").alias("line"), F.when(F.col("value").isin(*BLOCK_STARTS), F.lit("")).otherwise(F.col("value")).alias("v"))))
        in_block = F.col("kind").isNull() & (F.col("of_key") == "system-prompt") & F.col("of_value").isin(*BLOCK_STARTS) & F.col("line").rlike(r"\A(  |\t)")
        text = F.regexp_replace("line", X.rx(r"\A\s+"), "")
        block = F.collect_list(F.when(in_block, F.struct("line_no", F.col("of_line").alias("of"), text.alias("t"))))
        folded += [prompt.alias("system_prompt"), F.array_sort(block).alias("_block")]
    out = head.groupBy("artifact_id", "path").agg(*folded)
    if mode == "agent":
        own = F.filter("_block", lambda b: b["of"] == F.col("system_prompt.line"))
        full = F.concat(F.col("system_prompt.v"), F.aggregate(own, F.lit(""), lambda s, b: F.concat(s, F.lit("\n"), b["t"])))
        out = out.withColumn("system_prompt", F.when(F.col("system_prompt").isNotNull(), F.struct(F.col("system_prompt.line").alias("line"), full.alias("v")))).drop("_block")
    return out


def has_markup(value: Column) -> Column:
    return value.rlike("[<>]|&lt;|&gt;|&#")


def body(lines: DataFrame, mode: str) -> DataFrame:
    """n_lines, and the first lines with a backslash path and with a condition on a date, of each sentinel file."""
    own = lines.where(F.col("file_name") == SENTINELS[mode])
    first = lambda p: F.min(F.when(X.matches(F.col("line"), p), F.col("line_no")))
    return own.groupBy("artifact_id", "path").agg(F.count("*").alias("n_lines"), first(R.WINDOWS_PATH).alias("windows"), first(R.TIME).alias("dated"))


def finding(mode: str, rule: str, line: Column | None, message: Column | None = None) -> Column:
    found = next(r for r in RULES[mode] if r.id == f"{PREFIX[mode]}/{rule}")
    return F.struct(F.lit(found.id).alias("rule_id"), (line if line is not None else F.lit(None)).cast("long").alias("line"), (message if message is not None else F.lit(found.message)).alias("message"))


def counted(mode: str, rule: str, value: Column) -> Column:
    found = next(r for r in RULES[mode] if r.id == f"{PREFIX[mode]}/{rule}")
    return F.concat(F.lit(f"{found.message}: "), F.char_length(value).cast("string"))


def rule_array(mode: str) -> Column:
    """All findings of one sentinel file, in their order."""
    name, line = F.col("name.v"), F.col("name.line")
    low = F.lower(name)
    vague = F.exists(F.split(low, "-"), lambda s: s.isin(*R.VAGUE_NAMES))
    bad_format = X.matches(name, r"[\p{IsUppercase} _]")
    f = lambda test, *args: F.when(test, finding(mode, *args))
    description, d_line = F.col("description.v"), F.col("description.line")
    given = F.coalesce(X.trim(description) != "", F.lit(False))
    triggers = F.exists(F.array(*map(F.lit, R.TRIGGERS)), lambda t: F.contains(F.lower(description), t))
    of_name = [
        f(has_markup(name), "xml-in-frontmatter", line, F.lit("Markup in a metadata field: name")),
        f(low.rlike("claude|anthropic"), "name-reserved-word", line),
        f(bad_format, "invalid-name-format", line),
        f(F.char_length(name) > 64, "name-too-long", line, counted(mode, "name-too-long", name)),
        f(name.startswith("-") | name.endswith("-"), "name-leading-trailing-hyphen", line),
        f(F.contains(name, F.lit("--")), "name-consecutive-hyphens", line),
        f(vague, "name-too-vague", line),
        f(~bad_format & (name != F.col("directory")), "name-directory-mismatch", line),
    ]
    of_description = [
        f(~given, "description-missing", d_line),
        f(given & has_markup(description), "xml-in-frontmatter", d_line, F.lit("Markup in a metadata field: description")),
        f(given & (F.char_length(description) > 1024), "description-too-long", d_line, counted(mode, "description-too-long", description)),
        f(given & X.matches(description, R.FIRST_PERSON), "description-not-third-person", d_line),
        f(given & ~triggers, "description-no-trigger", d_line),
    ]
    of_body = [
        f(F.col("n_lines") > 500, f"{mode}-body-too-long", None),
        f(F.col("windows").isNotNull(), "windows-path", F.col("windows")),
        f(F.col("dated").isNotNull(), "time-sensitive-content", F.col("dated")),
    ]
    entries = lambda column, test, rule: F.transform(F.filter(F.coalesce(F.col(column), F.array().cast("array<struct<line:bigint,v:string>>")), test), lambda e: finding(mode, rule, e["line"]))
    bare = lambda e: F.lower(X.trim(e["v"])) == "bash"
    if mode == "skill":
        compatibility = F.col("compatibility.v")
        middle = [entries("allowed_tools", bare, "bare-bash-tool"), F.array(f((X.trim(compatibility) != "") & (F.char_length(compatibility) > 500), "compatibility-too-long", F.col("compatibility.line"), counted(mode, "compatibility-too-long", compatibility)))]
    else:
        prompt, p_line = F.col("system_prompt.v"), F.col("system_prompt.line")
        middle = [
            F.array(f(F.col("has_head") & F.col("model").isNull(), "model-not-specified", None)),
            entries("tools", bare, "bare-tool"),
            entries("mcp_servers", lambda e: ~F.contains(e["v"], F.lit("(")), "unconstrained-mcp-server"),
            F.array(
                f(has_markup(prompt), "xml-in-frontmatter", p_line, F.lit("Markup in a metadata field: system-prompt")),
                f(X.matches(prompt, R.SYSTEM_INJECTION), "system-prompt-injection", p_line),
                f(F.char_length(prompt) > 8000, "system-prompt-too-long", p_line, counted(mode, "system-prompt-too-long", prompt)),
            ),
        ]
    return F.array_compact(F.concat(F.array(*of_name), *middle, F.array(*of_description, *of_body)))


def scan_metadata(files: DataFrame, lines: DataFrame, artifacts: DataFrame, mode: str) -> DataFrame:
    """Findings on the sentinel file of each artifact: missing, beside a README, or its contents.

    artifacts: artifact_id, and name, the folder's name that the metadata should repeat.
    """
    sentinel = files.where(F.col("rel_path") == SENTINELS[mode])
    missing = artifacts.join(sentinel, "artifact_id", "left_anti").select("artifact_id", F.lit(SENTINELS[mode]).alias("path"), F.array(finding(mode, f"missing-{mode}-md", None)).alias("f"))
    found = artifacts.join(sentinel.select("artifact_id", "path", "content"), "artifact_id").where(F.col("content").isNotNull()).select("artifact_id", F.col("name").alias("directory"), "path")
    root_lines = lines.join(found.select("artifact_id", "path"), ["artifact_id", "path"], "left_semi")
    head = parsed(root_lines, mode).withColumn("has_head", F.lit(True))
    # a head without a line that counts is a head as well
    opened = root_lines.where((F.col("line_no") == 1) & (X.trim(F.col("line")) == "---")).select("artifact_id", "path", F.lit(True).alias("opened"))
    rows = found.join(head, ["artifact_id", "path"], "left").join(body(root_lines, mode), ["artifact_id", "path"], "left").join(opened, ["artifact_id", "path"], "left")
    rows = rows.withColumn("has_head", F.coalesce("opened", F.lit(False)))
    content = rows.select("artifact_id", "path", rule_array(mode).alias("f"))
    out = missing.unionByName(content)
    if mode == "skill":
        readme = files.where(F.col("rel_path") == "README.md").join(found.select("artifact_id"), "artifact_id", "left_semi")
        out = out.unionByName(readme.select("artifact_id", "path", F.array(finding(mode, "readme-in-skill", None)).alias("f")))
    each = out.select("artifact_id", "path", F.posexplode("f").alias("pos", "f"))
    return each.select("artifact_id", "path", "f.line", F.lit(SCANNER[mode]).alias("scanner"), "f.rule_id", "pos", "f.message", F.lit(None).cast("string").alias("snippet"))

