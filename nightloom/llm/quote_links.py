"""Quotation linking in DataFrame functions only.

A line's quote level is the number of marks (``>``) that it starts with. Runs of lines of one level are passages. The
normalised text of each quoted passage, and of each of its paragraphs and lines, is hashed and joined, within the
conversation, to the hashes of what earlier messages wrote themselves: their whole text, paragraphs and lines. Units of any
length count, but a short one only where it is the whole passage or the whole message. A message answers the one that
its outermost quotes match best (most characters, then the latest). Threads follow by pointer jumping, in as many rounds
as the logarithm of the longest chain of answers; within a conversation, sorting by (thread, turn) puts every answer
after what it answers. Joins go by conversation and hash or by conversation and turn together, never by conversation
alone, so that a very long conversation is spread.

A line that very many turns of a conversation write and quote would give all pairs of them. Units with more than ``HOT``
writers are therefore met by class: writers of the same hot units are one class, whose members match a quotation equally
well, so only the latest one before it counts, and the number of those before it. Both are looked up in blocks of turns.
Rows follow quotations times classes, and any other unit has at most HOT writers.

Defined results: null and empty texts quote nothing and have an empty own text; null conversations or turns link to
nothing and are their own thread; rows of equal conversation and turn share links and each return; ties go to the
latest turn; very long texts are cut into lines, whole; an empty table gives no rows; columns other than those named are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

# What starts a quoted line, and lines that introduce a quotation.
MARK = r"^[ \t]*>[> \t]*"
INTRO = r"(?i)(wrote|writes|said|schrieb|écrit|escribió)[^\p{L}\p{N}]*:[ \t]*$"
#: Units with fewer letters and digits than this are evidence only as a whole passage or a whole message.
LEAST = 12
#: Units with more writers than this in a conversation are met by class of writers.
HOT = 32
#: Turns of a block of the look-up.
BLOCK = 1024


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """conv, turn, mid (hash of the text), n (line), level, body, and the level of the next line."""
    split = messages.select("conv", "turn", F.xxhash64("text").alias("mid"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    mark = F.regexp_extract("line", MARK, 0)
    split = split.select("conv", "turn", "mid", "n", (F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), F.trim(F.regexp_replace("line", MARK, "")).alias("body"))
    return split.withColumn("next", F.lead("level").over(W.partitionBy("conv", "turn", "mid").orderBy("n")))


def own_text(text: Column) -> Column:
    """A message without its quoted lines and the lines that introduce them."""
    own = F.filter(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("i"))),
        lambda s: ~s["line"].rlike(MARK) & ~(s["line"].rlike(INTRO) & F.coalesce(F.get(F.split(text, "\n", -1), s["i"] + 1).rlike(MARK), F.lit(False))),
    )
    joined = F.array_join(F.transform(own, lambda s: s["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"^\s+", ""), r"\s+$", "")


def quoted(messages: DataFrame) -> DataFrame:
    """conv, turn, level, size, key: passages, their paragraphs and lines; those whose match needs no whole message end in "a"."""
    own = lines(messages.where(F.col("text").rlike("(?m)" + MARK)).select("conv", "turn", "text").distinct())
    w = W.partitionBy("conv", "turn", "mid").orderBy("n")
    own = own.where(~((F.col("level") < F.coalesce("next", F.lit(0))) & F.col("body").rlike(INTRO)))
    own = own.withColumn("new", F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    own = own.withColumn("par", F.sum((F.col("body") == "").cast("int")).over(w)).where("level > 0")

    def joined(*by: str) -> DataFrame:
        return own.groupBy("conv", "turn", "mid", *by, "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda s: s["body"]), " ").alias("body"))

    unit = lambda d, whole: d.select("conv", "turn", "level", "body", F.lit(whole).alias("whole"))
    units = unit(own, False).unionAll(unit(joined("run", "par"), False)).unionAll(unit(joined("run"), True)).withColumn("body", normal(F.col("body")))
    units = units.where(F.length("body") > 0).groupBy("conv", "turn", "level", F.md5("body").alias("hash")).agg(F.first(F.length("body")).alias("size"), F.max("whole").alias("all_quoted"))
    kind = F.when((F.col("size") >= LEAST) | F.col("all_quoted"), "a").otherwise("w")
    return units.select("conv", "turn", "level", "size", F.concat("hash", kind).alias("key"))


def written(messages: DataFrame) -> DataFrame:
    """conv, from, key: what messages wrote themselves, by line and paragraph (ending in "a") and as a whole ("w" too)."""
    own = messages.select("conv", "turn", own_text(F.col("text")).alias("own"))
    units = F.array_union(F.split("own", r"\n[ \t]*\n", -1), F.split("own", "\n", -1))
    both = lambda x, kinds: [F.struct(x.alias("unit"), F.lit(k).alias("kind")) for k in kinds]
    units = F.concat(F.array(*both(F.col("own"), "aw")), F.transform(units, lambda x: both(x, "a")[0]))
    units = own.select("conv", F.col("turn").alias("from"), F.inline(units)).withColumn("unit", normal(F.col("unit")))
    return units.where(F.length("unit") > 0).select("conv", "from", F.concat(F.md5("unit"), "kind").alias("key")).distinct()


def latest_before(members: DataFrame, probes: DataFrame) -> DataFrame:
    """conv, cls, turn, from, n: for each probe (conv, cls, turn) the latest member (conv, cls, from) before the turn and the
    number of members before it. Turns are looked at in blocks, so a class of very many members is spread."""
    block = F.floor(F.col("at") / BLOCK)
    both = members.select("conv", "cls", F.col("from").alias("at"), F.col("from").alias("member")).unionAll(probes.select("conv", "cls", F.col("turn").alias("at"), F.lit(None).cast("long").alias("member")))
    both = both.withColumn("block", block)
    sums = both.groupBy("conv", "cls", "block").agg(F.max("member").alias("top"), F.count("member").alias("count"))
    earlier = W.partitionBy("conv", "cls").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("_c"), F.col("cls").alias("_k"), F.col("block").alias("_b"), F.max("top").over(earlier).alias("top"), F.sum("count").over(earlier).alias("count"))
    # Of equal turns, a probe comes first: a message does not answer itself.
    within = W.partitionBy("conv", "cls", "block").orderBy("at", F.col("member").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("near", F.max("member").over(within)).withColumn("number", F.count("member").over(within)).where("member IS NULL")
    met = both.join(sums, (F.col("conv") == F.col("_c")) & (F.col("cls") == F.col("_k")) & (F.col("block") == F.col("_b")))
    return met.select("conv", "cls", F.col("at").alias("turn"), F.coalesce("near", "top").alias("from"), (F.col("number") + F.coalesce("count", F.lit(0))).alias("n"))


def parents(messages: DataFrame) -> DataFrame:
    """conv, turn, parent, links: the earlier turn that a message answers, and how many turns it quotes."""
    q = common.cut(quoted(messages).withColumn("turn", F.col("turn").cast("long")))
    asked = q.select("conv", "key").distinct()
    w = written(messages).withColumn("from", F.col("from").cast("long")).join(asked, ["conv", "key"], "left_semi")
    w = common.cut(w)
    hot = w.groupBy("conv", "key").agg(F.count("*").alias("writers")).where(F.col("writers") > HOT).select("conv", "key")
    cold = w.join(hot, ["conv", "key"], "left_anti").select(F.col("conv").alias("_c"), F.col("key").alias("_k"), "from")
    met = q.join(cold, (F.col("conv") == F.col("_c")) & (F.col("key") == F.col("_k")) & (F.col("from") < F.col("turn")))
    met = met.groupBy("conv", "turn", "level", "from").agg(F.sum("size").alias("cold"))

    own = w.join(hot, ["conv", "key"], "left_semi").groupBy("conv", "from").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    own = common.cut(own.select("conv", "from", "keys", F.md5(F.array_join("keys", ",")).alias("cls")))
    members = own.select("conv", "from", "cls")
    classes = own.groupBy("conv", "cls").agg(F.first("keys").alias("keys")).select(F.col("conv").alias("_c"), "cls", F.explode("keys").alias("_k"))
    sums = common.cut(q.join(classes, (F.col("conv") == F.col("_c")) & (F.col("key") == F.col("_k"))).groupBy("conv", "turn", "level", "cls").agg(F.sum("size").alias("hot")))
    found = common.cut(latest_before(members, sums.select("conv", "cls", "turn").distinct()).where("n > 0"))

    # A turn that is met by cold units has its hot ones added; of each class, the latest turn stands for the others.
    met = met.join(members, ["conv", "from"], "left").join(sums, ["conv", "turn", "level", "cls"], "left")
    met = common.cut(met.select("conv", "turn", "level", "from", (F.col("cold") + F.coalesce("hot", F.lit(0))).alias("size"), "cls"))
    by_class = sums.join(found, ["conv", "turn", "cls"]).select("conv", "turn", "level", "from", F.col("hot").alias("size"))
    best = F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("from")).alias("from")))
    up = met.select("conv", "turn", "level", "from", "size").unionAll(by_class).groupBy("conv", "turn").agg((-best["from"]).alias("parent"))
    # Links: members of the classes, and those met by cold units that are in none of them.
    apart = met.join(found.select("conv", "turn", "cls"), ["conv", "turn", "cls"], "left_anti").groupBy("conv", "turn").agg(F.count_distinct("from").alias("links"))
    links = apart.unionAll(found.groupBy("conv", "turn").agg(F.sum("n").alias("links"))).groupBy("conv", "turn").agg(F.sum("links").alias("links"))
    return up.join(links, ["conv", "turn"])


def threads(up: DataFrame) -> DataFrame:
    """conv, turn, thread, depth from (conv, turn, parent) by pointer jumping; turns without a parent are not listed."""
    at = common.cut(up.select("conv", "turn", F.col("parent").alias("thread"), F.lit(1).alias("depth")))
    while True:
        above = at.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"))
        step = at.join(above, (F.col("conv") == F.col("_c")) & (F.col("thread") == F.col("_t")), "left")
        at = common.cut(step.select("conv", "turn", F.coalesce("_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_thread").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, own text, parent, links, thread and depth. Order by (conv, thread, turn)."""
    own = common.keyed(messages, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    up = common.cut(parents(own))
    tied = up if up.isEmpty() else up.join(threads(up), ["conv", "turn"])
    tied = tied.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "parent", "links", *([F.lit(None).cast("long").alias("thread"), F.lit(None).cast("int").alias("depth")] if "thread" not in tied.columns else ["thread", "depth"]))
    out = own.join(tied, (F.col("conv") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), own_text(F.col("text")).alias("own_text"), "parent",
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce(F.col("thread"), F.col("turn")).alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def rendered_replies(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The messages as replies that quote: of every three turns, one quotes the turn before, one that and the one before it,
    and one quotes nothing. For tables whose messages hold no quotations. A turn that comes more than once is quoted by its least
    text; null texts are quoted as nothing; an empty table gives no rows; further columns are ignored."""
    own = common.keyed(messages, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    one = own.groupBy("conv", "turn").agg(F.min("text").alias("text"))
    back = lambda k: one.select(F.col("conv").alias(f"_c{k}"), (F.col("turn") + k).alias(f"_t{k}"), F.col("text").alias(f"_x{k}"))
    out = own
    for k in (1, 2):
        out = out.join(back(k), (F.col("conv") == F.col(f"_c{k}")) & (F.col("turn") == F.col(f"_t{k}")), "left")
    quote = lambda c, mark: F.concat(F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n"), F.lit("\n"))
    near, far = F.coalesce(quote(F.col("_x1"), "> "), F.lit("")), F.coalesce(quote(F.col("_x2"), "> > "), F.lit(""))
    text = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(near, F.coalesce("text", F.lit("")))).otherwise(F.concat(far, near, F.coalesce("text", F.lit(""))))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), text.alias(text_col))
