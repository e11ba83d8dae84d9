"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Each kind's matches are found leftmost first without overlap. Where they stand follows from the lengths of the pieces
between them (``split``) and of the matches themselves (``regexp_extract_all``). Candidate values, hashed, are then counted
over the whole corpus by distinct owners and repositories: a value that several owners have is an example that was copied
around, and one that many repositories of few owners have is a template; any other looks live. Besides the base kinds, the
method looks at long mixed tokens and adds those that look live as spans of kind ``owned``.

Hot values: owners and repositories are made distinct before they are counted, so a value on a third of all rows is
counted from as many rows as it has owners; joining the verdicts back goes by value against one row per value, which
adaptive execution can split.

Defined results: null and empty texts have no spans; a null owner or repository counts as one of its own; equal rows
get equal results and each return; spans that start together are in the order of KINDS; very long texts are scanned whole,
in steps of the number of matches to the power of 1.5; an empty table gives no rows; columns other than those named are
never read, and redact() hands on all columns, whatever their names. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the kinds, in Java's syntax. A hex or access match that is long enough is the same with
# the length in the pattern; an assignment is not, as a failing match uses up its text.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "owned": r"[A-Za-z0-9+/_=-]{24,}",
}
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string>"


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that a text without it has no match."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    if kind == "access":
        return text.contains("AKIA")
    return text.rlike(PATTERNS[kind])


def _spans(kind: str) -> Column:
    """Spans of a kind from its columns of matches (m_), values (v_) and pieces between them (p_)."""
    m, v, p, rank = f"m_{kind}", f"v_{kind}", f"p_{kind}", KINDS.index(kind)
    keep = {
        "assign": f"length(element_at({v}, i)) >= 12",
        "owned": f"element_at({m}, i) rlike '[a-z]' and element_at({m}, i) rlike '[A-Z]' and element_at({m}, i) rlike '[0-9]'",
    }.get(kind, "true")
    # Chunks of as many matches as there are chunks: an array that grows match by match would be copied as often.
    start = f"a.at + length(element_at({p}, i))"
    span = f"struct({start} as start, {rank} as rank, {start} + length(element_at({m}, i)) as stop, '{kind}' as kind, element_at({v}, i) as value)"
    step = f"struct({start} + length(element_at({m}, i)) as at, if({keep}, concat(a.spans, array({span})), a.spans) as spans)"
    each, none = f"cast(ceil(sqrt(size({m}))) as int)", f"cast(array() as array<{SPAN}>)"
    chunk = f"aggregate(sequence(k * {each} + 1, least(size({m}), (k + 1) * {each})), struct(acc.at as at, {none} as spans), (a, i) -> {step}, a -> struct(a.at as at, concat(acc.parts, array(a.spans)) as parts))"
    every = f"aggregate(sequence(0, cast((size({m}) - 1) div {each} as int)), struct(0 as at, cast(array() as array<array<{SPAN}>>) as parts), (acc, k) -> {chunk}, acc -> flatten(acc.parts))"
    return F.expr(f"case when size({m}) > 0 then {every} else {none} end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """id, h (hash of the text), owner, repo, and for each kind the array of its spans (s_)."""
    out = common.keyed(docs, id_col, owner_col, repo_col, text_col).toDF("id", "owner", "repo", "text").withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    found = []
    for kind in KINDS:
        worth = _worth(kind, F.col("text"))
        found.append(F.when(worth, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none).alias(f"m_{kind}"))
    out = out.select("*", F.xxhash64("text").alias("h"), *found)
    values = [F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(PATTERNS["assign"]), F.lit(2))).otherwise(none).alias("v_assign")]
    values += [F.col(f"m_{k}").alias(f"v_{k}") for k in KINDS[1:]]
    pieces = [F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"p_{k}") for k in KINDS]
    out = out.select("id", "owner", "repo", "h", *[f"m_{k}" for k in KINDS], *values, *pieces)
    return out.select("id", "h", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", F.coalesce(F.col("owner").cast("string"), F.lit("")), F.coalesce(F.col("repo").cast("string"), F.lit(""))).alias("repo"), *[_spans(k).alias(f"s_{k}") for k in KINDS])


def ownership(found: DataFrame) -> DataFrame:
    """Each candidate value's hash with the numbers of distinct owners and repositories that have it."""
    one = found.select("owner", "repo", F.explode(F.concat(*[f"s_{k}" for k in KINDS])).alias("s")).select(F.xxhash64("s.value").alias("vh"), F.crc32(F.col("s.value").cast("binary")).alias("vc"), "owner", "repo")
    repos = one.groupBy("vh", "vc", "owner", "repo").agg(F.lit(1).alias("_1")).groupBy("vh", "vc", "owner").agg(F.count("*").alias("repos"))
    return repos.groupBy("vh", "vc").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def _told(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """One row per document: id, h, base and all spans in order, those that look live (fewer owners and repositories than
    given) or copied, and the most owners and repositories of any of its values."""
    found = common.cut(scan(docs, id_col, text_col, owner_col, repo_col))
    one = found.where("size(s_assign) + size(s_access) + size(s_hex) + size(s_owned) > 0").select("id", "h", F.concat(*[f"s_{k}" for k in KINDS]).alias("all")).distinct()
    one = one.select("id", "h", F.explode("all").alias("s"))
    owners = ownership(found).select(F.col("vh").alias("_vh"), F.col("vc").alias("_vc"), "owners", "repos")
    judged = one.join(owners, (F.xxhash64("s.value") == F.col("_vh")) & (F.crc32(F.col("s.value").cast("binary")) == F.col("_vc")))
    live = (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    by_row = judged.groupBy("id", "h").agg(
        F.array_sort(F.collect_list(F.when(live, F.col("s")))).alias("live"), F.array_sort(F.collect_list(F.when(~live, F.col("s")))).alias("copied"), F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos")
    ).select(F.col("id").alias("_id"), F.col("h").alias("_h"), "live", "copied", "most_owners", "most_repos")
    none = F.array().cast(f"array<{SPAN}>")
    out = found.join(by_row, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    out = out.withColumn("live", F.coalesce("live", none)).withColumn("copied", F.coalesce("copied", none))
    base = F.array_sort(F.concat("s_assign", "s_access", "s_hex"))
    out = out.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", F.expr("filter(live, s -> s.kind = 'owned')"))))
    return out.select(F.col("id").alias(id_col), "h", "s_assign", "s_access", "s_hex", "base", "spans", "live", "copied", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("most_owners", "most_repos")])


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda c: F.size(c).cast("long")
    return spans.select(
        id_col, count("s_assign").alias("n_assign"), count("s_access").alias("n_access"), count("s_hex").alias("n_hex"),
        F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"), _told("spans").alias("spans"),
        count("live").alias("n_live"), count("copied").alias("n_copied"), "most_owners", "most_repos",
    )


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span's value that looks live, or is of a base kind, replaced by a mark; same columns and rows. Spans
    that overlap are one."""
    key, h, cut = common.unused(docs.columns, "_id", "_h", "_cut")
    last = "element_at(acc, -1)"
    grown = f"concat(slice(acc, 1, size(acc) - 1), array(struct({last}.start as start, greatest({last}.stop, s.stop) as stop)))"
    apart = F.expr(f"aggregate(spans, cast(array() as array<struct<start:int,stop:int>>), (acc, s) -> if(size(acc) > 0 and s.start < {last}.stop, {grown}, concat(acc, array(struct(s.start as start, s.stop as stop)))))")
    cuts = spans.where(F.size("spans") > 0).select(F.col(f"`{id_col}`").alias(key), F.col("h").alias(h), apart.alias(cut)).distinct()
    text = F.col(f"`{text_col}`")
    met = docs.join(cuts, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(h)), "left")
    before = f"if(i = 0, 0, element_at({cut}, i).stop)"  # places count from 0, elements from 1
    pieces = f"transform({cut}, (s, i) -> concat(substring(`{text_col}`, {before} + 1, s.start - {before}), '{mark}'))"
    masked = F.expr(f"concat(array_join({pieces}, ''), substring(`{text_col}`, element_at({cut}, -1).stop + 1))")
    return met.select(*[F.when(F.col(cut).isNotNull(), masked).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
