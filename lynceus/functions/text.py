"""Text semantics as column expressions.

Patterns follow the conventions of a Unicode-aware linear regex engine: `rx` switches Java to
Unicode classes and to line feeds as the only line ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SNIPPET = 120


#: Java matches repeated groups by recursion, which a line of thousands of repeats would overflow. A possessive
#: group is a loop; it stops before the last "-e", which backtracking would have given back. The labels of a host
#: name are bounded far above the 127 that a name can have; names with more match from a later label on.
LOOPS = {
    r"(-[a-zA-Z]+\s+)*(-e|--exec)\s+/bin/": r"(?:-(?!e\s+/bin/)[a-zA-Z]+\s+)*+(-e|--exec)\s+/bin/",
    r"(?:\.[a-z0-9][a-z0-9\-]{0,62})*": r"(?:\.[a-z0-9][a-z0-9\-]{0,62}){0,400}",
}


def rx(pattern: str) -> str:
    for repeated, loop in LOOPS.items():
        pattern = pattern.replace(repeated, loop)
    return "(?dU)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Strip Unicode white space at both ends; without a list of characters SQL's trim only knows the space."""
    return F.btrim(text, F.lit(WHITE))


def lines(content: Column) -> Column:
    """Lines without their ends; no line after a final line end, none in an empty text."""
    parts = F.split(content, r"\r?\n")
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def cut_long(text: Column) -> Column:
    """Texts of over 120 UTF-8 bytes are cut after 117 characters."""
    return F.when(F.octet_length(text) > MAX_SNIPPET, F.concat(F.substring(text, 1, 117), F.lit("..."))).otherwise(text)


def snippet_cut_first(line: Column) -> Column:
    return trim(cut_long(line))


def snippet_trim_first(line: Column) -> Column:
    return cut_long(trim(line))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), F.lit(group))


HOST = r"(?i)https?://(?:[^@/?#\s]+@)?([^/?#:\s]+)"


def hosts(line: Column) -> Column:
    return F.filter(F.transform(every(line, HOST, 1), F.lower), lambda h: h != "")


def in_list(host: Column, allowed: Sequence[str]) -> Column:
    """Whether a host is an entry, or lies below one; empty entries allow nothing."""
    entries = [re.escape(a.lower()) for a in allowed if a]
    return host.rlike(rf"(?:\A|\.)(?:{'|'.join(entries)})\z") if entries else F.lit(False)


def all_hosts_allowed(line: Column, allowed: Sequence[str]) -> Column:
    return let(hosts(line), lambda h: (F.size(h) > 0) & F.forall(h, lambda x: in_list(x, allowed)))


def entropy(token: Column) -> Column:
    """Shannon entropy of the token's UTF-8 bytes, in bits a byte; 0 for an empty token.

    Bytes are sorted first, so equal ones are runs and sums are made in the order of byte values.
    """
    codes = F.sort_array(F.regexp_extract_all(F.hex(F.encode(token, "UTF-8")), F.lit(".."), F.lit(0)))
    n = F.octet_length(token)
    state = lambda last, run, total: F.struct(last.alias("last"), run.cast("int").alias("run"), total.cast("double").alias("total"))
    part = lambda run: F.when(run > 0, -(run / n) * F.log2(run / n)).otherwise(F.lit(0.0))
    step = lambda a, c: F.when(a["last"] == c, state(c, a["run"] + 1, a["total"])).otherwise(state(c, F.lit(1), a["total"] + part(a["run"])))
    return F.aggregate(codes, state(F.lit(""), F.lit(0), F.lit(0.0)), step, lambda a: a["total"] + part(a["run"]))


def split_outside_parens(text: Column, separator: str) -> Column:
    """Trimmed items of a list whose separators within parentheses don't count. The last item is left out if empty."""
    state = lambda items, item, depth: F.struct(items.alias("items"), item.alias("item"), depth.cast("int").alias("depth"))

    def step(a: Column, c: Column) -> Column:
        depth = F.when(c == "(", a["depth"] + 1).when(c == ")", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        ends = (c == separator) & (a["depth"] == 0)
        return F.when(ends, state(F.array_append(a["items"], trim(a["item"])), F.lit(""), depth)).otherwise(state(a["items"], F.concat(a["item"], c), depth))

    last = lambda a: F.when(trim(a["item"]) == "", a["items"]).otherwise(F.array_append(a["items"], trim(a["item"])))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, state(F.array().cast("array<string>"), F.lit(""), F.lit(0)), step, last)
