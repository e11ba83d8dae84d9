"""Training-data operators against brute force, on small fixtures with nulls, empties, repeats, long texts and clashes."""

import collections
import hashlib
import importlib.util
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.llm import bpe, common, components, compression_quality, deleted_interpolation, filters, fitting, jaccard_join, media_jpeg, packing, quality_rules, quote_links, secrets, toxicity

from nightloom.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, kind int, _text string"


def made(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), 7, 8, "x") for i, t in rows], DOCS)


def corpus(seed=0, n=80):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, text(rng.choice((3, 12, 40, 90, 200)))) for i in range(n)]
    base = text(120).split()
    for i in range(n, n + 40):  # near copies of one text, some too far from it
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = "new" + str(rng.randrange(10**6))
        rows.append((i, " ".join(own)))
    rows += [(n + 40 + i, rows[0][1]) for i in range(9)] + [(n + 50, None), (n + 51, ""), (n + 52, " \n "), (None, text(30)), (None, None)]
    rows += [(n + 53, rows[1][1] + "\n" + rows[1][1].upper()), (n + 54, text(4000)), (n + 55, "one two"), (n + 56, "One TWO"), (3, rows[3][1]), (n + 57, "é " * 60)]
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(x):
    return (x or "").encode().split()


# --- 1 ---


def brute_stats(x):
    x = x or ""
    ws = [w.decode() for w in words(x)]
    lines = [y for y in x.split("\n") if words(y)]
    win = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {p for i in range(len(ws) - 2) if win[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for y in lines:
        dup += y in seen
        seen.add(y)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in x), dup, len(hit)


def test_text_stats_by_brute_force():
    for _, x in [*corpus(), (0, "a b c a b c a b"), (0, "x\nx\n \n\nx|#"), (0, "a a a a"), (0, "  a\x1cb  ")]:
        assert quality_rules.text_stats((x or "").encode())[:5] == brute_stats(x)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5)):
        assert math.isclose(quality_rules.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_are_certified_and_strict(spark):
    good = [(i, " ".join(f"w{j}x{i}" for j in range(60))) for i in range(900)]
    bad = [(1000 + i, " ".join(f"w{j}### " for j in range(60))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(made(spark, good + bad), labels).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)
    few = quality_rules.quality_rules(made(spark, good[:100] + bad), labels).collect()
    assert all(r.kept for r in few)  # too few labels to certify a cutoff
    stats = quality_rules.add_stats(made(spark, good))
    for c in quality_rules.select_cutoffs(stats, labels):
        assert quality_rules.binomial_tail(c.rejected, c.good, 0.01) <= 0.05 / 5


def union_fixture(seed=0, n=2400):
    """Good texts of which a few are odd under one rule or another, bad ones that are odd throughout."""
    rng = random.Random(seed)
    rows, quality = [], []
    for i in range(n):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if i % 8 == 0:
            ws = [w + rng.choice(("###", "!!!", "|%")) for w in ws]
        elif rng.random() < 0.02:
            ws[: rng.randint(5, 50)] = [rng.choice(("A#", "B!", "CC"))] * 30
        rows.append((i, " ".join(ws)))
        quality.append((i, int(i % 8 != 0)))
    return rows, quality


def test_rules_together_reject_few_good_documents(spark):
    rows, quality = union_fixture()
    labels = spark.createDataFrame(quality, "doc_id long, quality int")
    stats = quality_rules.add_stats(made(spark, rows)).cache()
    found = quality_rules.select_cutoffs(stats, labels)
    assert len({c.rule for c in found}) > 1
    by, truth = {r.doc_id: r for r in quality_rules.apply_rules(stats, found).collect()}, dict(quality)
    held = [i for i, q in quality if q and hashlib.md5(str(i).encode()).hexdigest()[-1] not in "048c"]
    rejected = sum(bool(by[i].failed_rules) for i in held)
    assert {(c.good, c.rejected) for c in found} == {(len(held), rejected)}  # of all rules together
    assert quality_rules.binomial_tail(rejected, len(held), 0.01) <= 0.01
    assert sum(not by[i].kept for i in by if not truth[i]) > 0.9 * sum(not q for q in truth.values())


def test_certified_rules_against_sql(spark):
    import duckdb
    import pandas as pd

    from nightloom.llm import oracle

    rows, quality = union_fixture(1)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t, "en") for i, t in rows], columns=["doc_id", "text", "lang"]))
    con.register("labels", pd.DataFrame(quality, columns=["doc_id", "quality"]))
    want = dict(con.execute(f"SELECT doc_id, failed_rules || kept FROM ({oracle.OP1})").fetchall())
    got = {r.doc_id: ",".join(r.failed_rules) + str(r.kept).lower() for r in quality_rules.quality_rules(made(spark, rows), spark.createDataFrame(quality, "doc_id long, quality int")).collect()}
    assert got == want and any(x.strip("truefals") for x in got.values())


def test_quality_rules_on_odd_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_rules(made(spark, rows), labels)
    assert sorted(map(str, (tuple(r)[:1] + (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()))) == sorted(str((i, *brute_stats(t))) for i, t in rows)
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0


# --- 2 and 10 ---


def labelled(seed=1, n=160):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "su", "ro", "en"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, quality, toxic = [], [], []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(30, 120))]
        bad, rude = i % 3 == 0, i % 4 == 1
        if rude:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(("grumblefoot", "snotwaffle", "drivelhead"))
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in ws)))
        quality.append((i, int(not bad)))
        toxic.append((i, int(rude)))
    return rows, quality, toxic


def test_compression_classifier(spark):
    rows, quality, _ = labelled()
    docs, labels = made(spark, [*rows, (900, None), (901, ""), (900, None)]), spark.createDataFrame([*quality, (None, 1), (7, None)], "doc_id long, quality int")
    model = compression_quality.quality_model(docs, labels, common.fold(F.col("_id"), 5) != 0, 200)
    got = {r.doc_id: r for r in compression_quality.score(docs, model).collect()}
    held = [(i, q) for i, q in quality if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    assert compression_quality.score(empty(spark), model).count() == 0
    none = compression_quality.quality_model(docs, labels.where("doc_id < 0"))
    assert {r.score for r in compression_quality.score(docs, none).collect()} == {0.5}


def test_normalised_differences_by_brute_force():
    import zstandard

    rng = random.Random(2)
    texts = [(" ".join("".join(rng.choices("abc", k=4)) for _ in range(300)).encode(), k % 2) for k in range(40)]
    model = compression_quality.Model(compression_quality.dictionaries(texts, 4000), None)

    def size(data, d, step):
        kind = {} if d[:4] == b"\x37\xa4\x30\xec" else {"dict_type": zstandard.DICT_TYPE_RAWCONTENT}
        made_ = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, **kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made_.compress(data[i : i + step])) for i in range(0, len(data), step))

    for x in (b"abca bcab " * 100, b"Zz9 !" * 7, b"x"):
        want = []
        for step in compression_quality.BLOCKS:
            (a, b), (c, d) = ([size(v, m, step) for m in model.dictionaries[k : k + 2]] for v, k in ((x, 0), (compression_quality.shape(x), 2)))
            want += [(b - a) / (b + a), (d - c) / (d + c), (b - a) / len(x), (d - c) / len(x)]
        assert np.allclose(model.features(x), want, atol=0.02)
    assert set(model.features(b"")) == {0.0}


def test_whole_long_texts_teach(spark):
    """Labelled texts of 70 KB are part of the sample, whole; a budget ends behind a whole text."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9000))) for i in range(6)] + [(9, None), (3, "repeated id")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(0, 1), (None, 1)], "doc_id long, quality int")
    got = {r._id: (r._label, r._text) for r in fitting.labelled_sample(made(spark, rows), labels, "quality", 50).collect()}
    texts = dict(reversed(rows))
    assert got == {i: (int(i % 2 or i == 0), "" if i == 9 else "repeated id" if i == 3 else texts[i]) for i in (0, 1, 2, 3, 4, 5, 9)}
    assert compression_quality.within([(1, 0, 60), (2, 0, 60), (3, 0, 1), (4, 1, 500)], 100) == [1, 2, 4]


def test_fit_on_executors_is_the_fit_in_one_place(spark):
    rows, _, toxic = labelled()
    docs, labels = made(spark, rows), spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels, None, 200)
    sample = sorted((r._rank, r._build, r._text.encode(), r._label) for r in fitting.labelled_sample(docs, labels, "toxic", 200).collect())
    one = toxicity.fit(*[[(t, y) for _, b, t, y in sample if b == side] for side in (True, False)])
    assert model.odds.keys() == one.odds.keys() and all(math.isclose(model.odds[w], one.odds[w]) for w in one.odds)
    data = [t.encode() for _, t in rows[:40]]
    assert np.allclose(model.scores(data), one.scores(data))


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More rows of a label than any earlier bound: odds and scores are those of all rows fitted in one place."""
    rows = [(i, f"mild{i % 50} ka lo" + (" grumblefoot" if i % 4 == 1 else "") + (" dom" if i % 3 == 0 else "")) for i in range(9000)]
    docs, labels = made(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(9000)], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels)
    sample = [(r._build, (r._text.encode(), r._label)) for r in fitting.labelled_sample(docs, labels, "toxic", None).collect()]
    assert len(sample) == 9000
    one = toxicity.fit(*[[x for b, x in sample if b == side] for side in (True, False)])
    assert model.odds.keys() == one.odds.keys() and all(math.isclose(model.odds[w], one.odds[w]) for w in one.odds)
    assert model.chars.three == one.chars.three
    data = [t.encode() for _, t in rows[:100]]
    assert np.allclose(model.scores(data), one.scores(data))


def test_rare_words_in_the_table_of_odds():
    counts = [("chance", 0, 2), ("telling", 1, 9), ("frequent", 100, 1), ("once", 0, 1)]
    assert [(w, has) for w, _, has in toxicity.log_odds(counts, (90_000, 10_000))] == [("chance", False), ("telling", True), ("frequent", True)]
    model = toxicity.Model(toxicity.CharModel({"grumble": 5, "mild": 3}), {"grum+": 3.0, "grumble": 5.0})
    odds = [("grumpily", -1.0, False), ("mildly", -1.0, False), ("grumpi+", 0.5, False), ("mildl+", 0.1, False), ("grumble", 5.0, True)]
    assert dict(toxicity.exceptions(odds, model)) == {"grumpily": -1.0, "grumpi+": 0.5}
    assert len(toxicity.CharModel({"дом": 2, "город": 3, "мир": 1}).three) == len(toxicity.CharModel({"дом": 2}).three)


def brute_odds(model, token):
    """Log-odds of a token without a cache: restored, else as it stands, else by the longest prefix."""
    for w in (model.restored(token), token.strip(toxicity._EDGE)):
        for key in (w, *(w[:k] + "+" for k in (7, 6, 5, 4) if len(w) > k)):
            if key in model.odds:
                return model.odds[key]
    return model.none


def brute_shreds(model, tokens, longest=8):
    """Words that neighbouring tokens make together, of all runs of up to ``longest`` tokens."""
    runs = [tuple(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 2, min(i + longest, len(tokens)) + 1)]
    return {w: s for w, s in (model.joined(r) for r in runs) if s > toxicity.JOINED}


def fast_shreds(model, text):
    tokens = toxicity.tokens_of(text.encode())
    return model.shreds(tokens, {w: at for w in set(tokens) if (at := model.opening(w))}, toxicity.JOINED, {})


def test_scores_by_brute_force(spark):
    rows, _, toxic = labelled()
    model = fitted_toxicity(rows, toxic)
    c, mean, scale = model.calibration
    for _, t in rows[:60]:
        data = t.encode()
        each = [brute_odds(model, w.lower()) for w in set(t.split())] + [s for w, s in brute_shreds(model, t.lower().split()).items() if w not in t.lower().split()]
        top = sorted([*each, *[model.none] * 3], reverse=True)[:3]
        x = (np.array([*top, max(top[0] - 4.5, 0), max(top[1] - 4.5, 0)]) - mean) / scale
        assert math.isclose(model.scores([data])[0], 1 / (1 + math.exp(-max(-30, min(30, x @ c[:-1] + c[-1])))), rel_tol=1e-9)


def test_words_in_shreds(spark):
    rows, _, toxic = labelled()
    model = fitted_toxicity(rows, toxic)
    mild = b"ka lo mi ter " * 20
    for shreds in ("gru mbl efo ot", "sno t waf fle", "dr ive lh ead", "grumblef oot", "g rumblefoot", "snotwaff le", "drivel headish", "GRUM blefóot", "snotw - affle"):
        assert max(fast_shreds(model, shreds.replace(" - ", " ")).values(), default=0) > 2, shreds
        assert model.scores([mild + shreds.encode()])[0] > model.scores([mild])[0], shreds
    assert not fast_shreds(model, "ka lo mi")
    assert not fast_shreds(model, "grumblefoot grumblefoot - snotwaffle")  # whole words need no joint
    rng = random.Random(7)  # what is not decoded would have given nothing
    for _ in range(300):
        run = " ".join(rng.choice(("gru", "mbl", "efo", "ot", "ka", "sno", "tw", "aff", "le", "mb,", "oot", "fle", "e.", "grumblef", "sn0", "driv", "elhead", "t")) for _ in range(rng.randint(2, 7)))
        assert max(fast_shreds(model, run).values(), default=0) == max(brute_shreds(model, run.split()).values(), default=0), run
    assert len(model.scores([b"g " * 50_000 + b"gr gru grum " * 20_000])) == 1  # shreds that add no letter end a word


def test_accents_widths_and_unknown_signs(spark):
    rows, _, toxic = labelled()
    model = fitted_toxicity(rows, toxic)
    for disguise in ("grümblefööt", "ｓｎｏｔｗａｆｆｌｅ", "dri\u0301velhead", "gr#mblefoot", "snotw%ffle", "driv?lhead"):
        assert model.word(disguise) > 2, disguise
    assert toxicity.tokens_of("Ïdiot ｘ１ \u0301 a\u00a0b".encode()) == ["idiot", "x1", "a", "b"]
    assert toxicity.spaced_runs("ï d ï ó t".encode()) == {"idiot"}
    long = "grumble" * 5
    assert toxicity.CharModel({long: 1}).three["umb"] == 5  # words of any length teach


def fitted_toxicity(rows, toxic):
    truth = dict(toxic)
    sample = random.Random(0).sample([((t or "").encode(), truth[i]) for i, t in rows if i in truth], len(truth))
    return toxicity.fit(sample[::2], sample[1::2])


def test_toxicity_shortcuts_change_nothing():
    rng, chars = np.random.RandomState(3), toxicity.CharModel({"grumble": 5, "foot": 3, "don't": 2, "grumpy": 1})
    model = toxicity.Model(chars, {"grumble": 5.0, "grum+": 3.0, "foot": 2.5, "don't": 4.0, "a.b": 3.0, "grumb": 2.2}, -0.5)
    tokens = ["".join(rng.choice(list("grumblefoten.,'\":;?!$3é-"), rng.randint(1, 9))) for _ in range(4000)]
    cache: dict = {}
    for token in [*tokens, "don'", "don't", "don,", "a.", "a", "grumble,", "grummble.", "foot?!", "grumbl\"'"]:
        plain = model.found(model.restored(toxicity.folded(token)))
        plain = model.found(toxicity.folded(token).strip(toxicity._EDGE)) if plain is None else plain
        plain = model.none if plain is None else plain
        own = model.judged(token, cache)
        assert own == (model.word(token), model.opening(token))
        assert own[0] == plain or toxicity._ODD.search(toxicity.folded(token))
    assert model.judged("grumble,", cache) == model.judged("grumble", cache) and "grumble" in cache


def test_toxicity_looks_at_few_tokens():
    """What stacks of texts are glanced at leaves out changes no feature, and is most of a plain text."""
    rng, chars = random.Random(5), toxicity.CharModel({"grumble": 5, "foot": 3, "don't": 2, "grumpy": 1})
    odds = {"grumble": 5.0, "grum+": 3.0, "foot": 2.5, "don't": 4.0, "a.b": 3.0, "grumb": 2.2, "good": 0.9, "goo+": 0.8, "mellow": 0.4, "mello+": 0.3, "(x": 2.1, "": 0.1, "straße": 2.4, "kindness": -1.0}
    pieces = ["gru", "mble", "foot", "fo", "ot", "good", "goood", "goodly", "mellow", "mel", "low", "straße", "дом", "é", "ǆ", "g r u m b l e", "f o o t", "-", "«", "|", "(", "x", "don't", "don", "kindness", "!!", "%%%", "$", "\u034f", "\u00a0", " ", "𝚺"]
    for none in (0.0, -0.5):
        model = toxicity.Model(chars, odds, none)
        texts = ["".join(rng.choice(pieces) + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 30))).encode() for _ in range(1500)]
        for data, got in zip(texts, model.features_of(texts, {}), strict=True):
            tokens = toxicity.tokens_of(data)
            near = [w for w in tokens if not toxicity.MARKS.issuperset(w)]
            each = {w: model.word(w) for w in tokens}
            top = sorted([*each.values(), *[none] * 3], reverse=True)[2]
            more = model.shreds(near, {w: at for w in set(near) if (at := model.opening(w))}, max(toxicity.JOINED, top), {})
            for run in toxicity.spaced_runs(data):
                more |= model.spaced(run)
            top = sorted([*(more | each).values(), *[none] * 3], reverse=True)[:3]
            assert got == (*top, max(top[0] - 4.5, 0.0), max(top[1] - 4.5, 0.0)), data
    cache: dict = {}
    plain = ["".join(rng.choice("bcdhjkpqvwz") for _ in range(6)) + rng.choice(("", ",", "%%%", "tt")) for _ in range(3000)]
    assert model.features(" ".join([*plain, "foot", "good", "mellow"]).encode(), cache)[0] == 2.5 and len(cache) < 30
    assert toxicity._folded("ὁσ𝚺 é´b\u0301ıǆ") == toxicity.folded("ὁσ𝚺 é´b\u0301ıǆ")


def test_toxicity(spark):
    rows, _, toxic = labelled()
    docs, labels = made(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels, common.fold(F.col("_id"), 5) != 0, 200)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, q) for i, q in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    for disguise in ("grumblef00t", "gruuumblefooot", "g.r.u.m.b.l.e.f.o.o.t", "$notw@ffle", "dr1velhead"):
        assert model.word(disguise) > 2, disguise
    assert toxicity.spaced_words(b"so g r u m b l e f o o t it is") == {"grumblefoot"}
    scores = model.scores([b"ka lo mi ter " * 20 + b"s n o t w a f f l e d r i v e l h e a d grumblef00t", b"ka lo mi ter " * 20])
    assert scores[0] > 0.5 > scores[1]
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit([], []).scores([b"x"]).tolist() == [0.0]


def test_disguises_of_every_kind_and_length(spark):
    rows, _, toxic = labelled()
    model = fitted_toxicity(rows, toxic)
    for disguise in ("grumbl" + "e" * 30 + "foot", "g...r...u...m...b...l...e...f...o...o...t", "g/r/u/m/b/l/e/f/o/o/t", "g:r:u:m:b:l:e:foot", "d,r,i,v,e,l,h,e,a,d", "ggrruummbblleeffoott", "drivvelhead", "g\\rumblefoot"):
        assert model.word(disguise) > 2, disguise
    mild = b"ka lo mi ter " * 20
    spaced = lambda x: mild + " ".join(x).encode()
    assert model.scores([spaced("grumblefootsnotwaffledrivelhead")])[0] > 0.5 > model.scores([mild])[0]
    assert model.scores([mild + b"g / r / u / m / b / l / e / f / o / o / t"]) > model.scores([mild])
    assert toxicity.spaced_runs(b"a b c  d e f x y") == {"abc defxy"}
    assert toxicity.restore("x" * 50_000 + "." * 50_000, model.chars) in {"x", "xx"}


def test_restoration_is_the_best_path():
    """Viterbi against all paths of the lattice."""
    chars = toxicity.CharModel({"grumble": 5, "foot": 3, "tofu": 2})
    for token in ("gr0", "f00t", "t.o", "1l|"):
        best = None
        paths = [("\x02\x02", 0.0, "")]
        for column in toxicity.columns(token):
            new = []
            for context, p, text in paths:
                for letters, cost in column:
                    q, c = p + cost, context
                    for x in letters:
                        q += chars.log(c, x)
                        c = c[1] + x
                    new.append((c, q, text + letters))
            paths = new
        best = max(p + chars.log(c, "\x03") for c, p, _ in paths)
        found = toxicity.restore(token, chars)
        assert any(t == found and math.isclose(p + chars.log(c, "\x03"), best) for c, p, t in paths)


# --- 3 ---


def brute_components(rows, size=4, percent=85):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = words(t and t.encode().translate(low).decode())
        sets.append((i, {tuple(w)} if 0 < len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


@pytest.mark.parametrize(("small", "share"), [(6, 10_000), (2, 10_000), (2, 4), (2, 1)])
def test_jaccard_components_by_brute_force(spark, small, share, monkeypatch):
    """With small buckets and few hot ones, so that every way to meet a hub is taken."""
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", share)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 1)
    rows = corpus(small)
    got = sorted(map(str, map(tuple, jaccard_join.similar_components(made(spark, rows)).collect())))
    assert got == sorted(map(str, brute_components(rows)))
    assert jaccard_join.similar_components(empty(spark)).count() == 0


def test_signatures_meet_whenever_sets_are_similar():
    """The pigeonhole guarantee, for random pairs around the threshold."""
    rng = np.random.default_rng(0)
    for _ in range(600):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) > 0.08 * rng.random()], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)])
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            a, b = (set(np.concatenate([s for _, s, _ in jaccard_join.signatures(t)]).tolist()) for t in (x, y))
            assert a & b, (len(x), len(y), both)


def test_signatures_meet_under_the_pipeline_s_rule():
    """The pigeonhole guarantee for five words and 0.8."""
    rng = np.random.default_rng(1)
    rule, met = jaccard_join.Rule(5, 80, 100), 0
    for _ in range(600):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) > 0.11 * rng.random()], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 9))).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            met += 100 * both < 85 * (len(x) + len(y) - both)
            a, b = (set(np.concatenate([s for _, s, _ in jaccard_join.signatures(t, rule)]).tolist()) for t in (x, y))
            assert a & b, (len(x), len(y), both)
    assert met > 50


def test_pipeline_drops_near_duplicates_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    text = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, *(f"x{i}" for i in range(20))])), (3, " ".join([*text, *(f"y{i}" for i in range(30))]))]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, made(spark, rows), "").collect()}
    assert kept == {1, 3}  # 96 of 116 shingles are 0.83, 96 of 126 are 0.76
    assert [r.component_id for r in jaccard_join.similar_components(made(spark, rows)).sort("doc_id").collect()] == [1, 2, 3]


def test_allocation_covers_its_need():
    for need in range(1, 60):
        for size in (need * 6, need * 7):
            ones, zeros = jaccard_join.allocate(need, size)
            assert 2 * ones + zeros >= need
    assert any(jaccard_join.band_plan(j)[0] for j in range(12))


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(5, 5), (None, 7), (7, None), (None, None), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 0 for i in range(1, 40)}


# --- 4 ---


def test_jpeg_round_trip():
    rng = random.Random(0)
    data = [bytes(rng.choices(range(256), k=576 * rng.randint(1, 4))) for _ in range(8)]
    data += [bytes(rng.choices((126, 127, 128, 129, 130), (1, 3, 30, 3, 1), k=1152)) for _ in range(8)] + [b"\x80" * 576, b"\xff" * 576]
    files = media_jpeg.encode(data)
    assert [media_jpeg.payload(*x) for x in media_jpeg.decode(files)] == data
    assert files == [media_jpeg.encode([d])[0] for d in data]  # a file does not depend on its batch
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and b"\xff\xc2" in f for f in files)


def test_inverse_transform_and_colours():
    c = np.zeros((1, 64), np.int32)
    c[0, 0] = 8 * 50
    assert set(media_jpeg.pixels(c, np.ones(64))[0]) == {178}
    rng = np.random.default_rng(0)
    c = rng.integers(-60, 60, (5, 64))
    basis = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    for block, want in zip(media_jpeg.pixels(c, np.ones(64)), c, strict=True):
        natural = np.zeros(64)
        natural[media_jpeg.ZIGZAG] = want
        exact = np.clip(basis.T @ natural.reshape(8, 8) @ basis + 128, 0, 255)
        assert np.abs(block.reshape(8, 8) - exact).max() <= 1
    f, planes = media_jpeg.decode(media_jpeg.encode([b"\x80" * 576]))[0]
    assert (media_jpeg.tensor(f, planes) == 128).all()


def test_files_without_restarts_and_with_long_runs():
    """The reference decoder reads a hand-written file: two blocks, runs of ended blocks, a refinement with new coefficients."""
    bits = ""

    def put(table, symbol):
        code, length = media_jpeg.codes(table)
        return format(int(code[symbol]), f"0{int(length[symbol])}b")

    def body(bits):
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")

    seg = media_jpeg._segment
    frame = b"\x08\x00\x08\x00\x10\x01\x01\x11\x00"  # 16 x 8 pixels, one component
    huff = b"".join(bytes([k]) + bytes(t[0]) + bytes(t[1]) for k, t in ((0x00, media_jpeg.DC_TABLE), (0x10, media_jpeg.FIRST_TABLE), (0x11, media_jpeg.REFINE_TABLE)))
    start = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, frame) + seg(0xC4, huff)
    dc = put(media_jpeg.DC_TABLE, 3) + "101" + put(media_jpeg.DC_TABLE, 0)  # 5, then the same
    first = put(media_jpeg.FIRST_TABLE, 0x21) + "1" + put(media_jpeg.FIRST_TABLE, 0x10) + "0"  # 0 0 1, then two blocks end
    # Refinement: block 0 gets -1 at place 2 (one zero before it), then a correction 1 for place 3; both blocks end.
    refine = put(media_jpeg.REFINE_TABLE, 0x11) + "0" + put(media_jpeg.REFINE_TABLE, 0x10) + "0" + "1"
    scan = lambda a, b, hl, use: seg(0xDA, bytes([1, 1, use, a, b, hl]))
    data = start + scan(0, 0, 0x00, 0) + body(dc) + scan(1, 63, 0x01, 0) + body(first) + scan(1, 63, 0x10, 1) + body(refine) + b"\xff\xd9"
    f, (plane,) = media_jpeg.decode([data])[0]
    assert plane[:, 0].tolist() == [5, 5] and plane[0, 1:5].tolist() == [0, -1, 3, 0] and not plane[1, 1:].any()
    assert media_jpeg.tensor(f, [plane]).shape == (8, 16, 3)
    assert bits == ""


def test_refinement_behind_a_run_of_ended_blocks():
    """Blocks 0 and 1 end together; block 2 has a new coefficient of its own."""

    def put(table, symbol):
        code, length = media_jpeg.codes(table)
        return format(int(code[symbol]), f"0{int(length[symbol])}b")

    def body(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    seg = media_jpeg._segment
    huff = b"".join(bytes([k]) + bytes(t[0]) + bytes(t[1]) for k, t in ((0x00, media_jpeg.DC_TABLE), (0x10, media_jpeg.FIRST_TABLE), (0x11, media_jpeg.REFINE_TABLE)))
    start = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, b"\x08\x00\x08\x00\x18\x01\x01\x11\x00") + seg(0xC4, huff)
    first = "".join(put(media_jpeg.FIRST_TABLE, 1) + "1" + put(media_jpeg.FIRST_TABLE, 0) for _ in range(3))  # each: 1 at place 1
    refine = put(media_jpeg.REFINE_TABLE, 0x10) + "0" + "1" + "0" + put(media_jpeg.REFINE_TABLE, 0x01) + "1" + "1" + put(media_jpeg.REFINE_TABLE, 0)
    scan = lambda a, b, hl, use: seg(0xDA, bytes([1, 1, use, a, b, hl]))
    data = start + scan(0, 0, 0, 0) + body(put(media_jpeg.DC_TABLE, 0) * 3) + scan(1, 63, 0x01, 0) + body(first) + scan(1, 63, 0x10, 1) + body(refine) + b"\xff\xd9"
    (_, (plane,)), = media_jpeg.decode([data])
    assert plane[:, 1].tolist() == [3, 2, 3] and plane[:, 2].tolist() == [0, 0, 1] and not plane[:, 3:].any()


def test_refinements_by_brute_force():
    """The tokens of new coefficients against the block-wise coder, and texts that are rich in them there and back."""
    rng = np.random.default_rng(3)
    c = rng.choice([-40, -3, -2, -1, 0, 1, 2, 3, 50], size=(400, 63), p=[0.2, 0.1, 0.1, 0.1, 0.05, 0.1, 0.1, 0.05, 0.2])
    c[(np.abs(c) == 1).sum(1) == 0, 0] = 1
    c = c[(c == 0).sum(1) <= 15]
    data, lens = media_jpeg._refine_tokens(c)
    at = 0
    for row, n in zip(c.tolist(), lens.tolist(), strict=True):
        bits = media_jpeg._refine_bits(row)
        bits += [1] * (-len(bits) % 8)
        assert np.packbits(np.array(bits, np.uint8)).tolist() == data[at : at + n].tolist()
        at += n
    texts = [("съешь ещё этих булок с сыром ÁÁ " * 400).encode(), bytes([127, 128, 129]) * 3000, b"\x81" * 2000, bytes(rng.integers(126, 131, 9000).tolist())]
    payloads = [media_jpeg.padded(x) for x in texts]
    assert [media_jpeg.payload(*x) for x in media_jpeg.decode(media_jpeg.encode(payloads))] == payloads


def test_colour_tensor_by_a_second_decoder():
    """A file with subsampled chroma: blocks by the cosine sum, chroma doubled by hand, colours in floating point."""
    data = media_jpeg.padded(bytes(np.random.default_rng(4).integers(118, 139, 1500).tolist()))
    f, planes = media_jpeg.decode(media_jpeg.encode([data]))[0]
    w, h = f.mcus()
    flat = np.full(w * h * 384, 128)
    flat[: len(data)] = list(data)
    flat = flat.astype(float) - 128
    basis = [[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))

    def image(blocks, across, down):
        out = np.zeros((down * 8, across * 8))
        for i, block in enumerate(blocks):
            grid = np.zeros((8, 8))
            for (u, v), value in zip(cells, block, strict=True):
                grid[u, v] = value
            out[i // across * 8 :, i % across * 8 :][:8, :8] = np.array(basis).T @ grid @ np.array(basis)
        return np.clip(np.round(out + 128), 0, 255)

    m = w * h
    y, cb, cr = image(flat[: m * 256].reshape(-1, 64), 2 * w, 2 * h), image(flat[m * 256 : m * 320].reshape(-1, 64), w, h), image(flat[m * 320 :].reshape(-1, 64), w, h)
    cb, cr = (np.kron(x, np.ones((2, 2))) - 128 for x in (cb, cr))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    got = media_jpeg.tensor(f, planes)
    assert got.shape == want.shape == (16 * h, 16 * w, 3) and np.abs(got - want).max() <= 3 and got.std() > 5


def test_media_columns(spark):
    rows = corpus()
    got = media_jpeg.digests(media_jpeg.encode_column(made(spark, rows))).collect()
    by_text = collections.defaultdict(set)
    want = collections.Counter()
    for i, t in rows:
        p = media_jpeg.padded((t or "").encode())
        want[str((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))] += 1
    assert collections.Counter(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == want
    for r in got:
        by_text[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    t = media_jpeg.tensor_column(media_jpeg.encode_column(made(spark, rows[:3]))).first()
    assert len(t.rgb) == t.height * t.width * 3
    assert media_jpeg.digests(media_jpeg.encode_column(empty(spark))).count() == 0


# --- 5 ---

KEY = "AKIA" + "ABCDEFGHIJ0123456789"
SECRETS = [
    (0, f"password = 'abcdefghijkl' and {KEY} then 0123456789abcdef0"), (1, "TOKEN:short password=token=abcdefghijklmnop secret=token: abcdefghijklmnop"), (2, "é日本 api_key:\"aBcD/+=.-_12345\" end"),
    (3, None), (4, ""), (5, "deadbeefdeadbeef" * 3 + " AKIAAKIA" + "B" * 16 + " AKIA123"), (6, "live Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9 x"), (6, "live Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9 x"), (None, "secret: abcdefabcdefabcdef"), (8, "\n".join(["passwd: Aa1" + "x" * 20] * 200)),
]
SECRETS += [(20 + i, "copied Qq7Qq7Qq7Qq7Qq7Qq7Qq7Qq7Qq7") for i in range(8)]


def test_secret_base_spans_by_brute_force(spark):
    import re

    got = secrets.digests(secrets.secret_spans(made(spark, SECRETS))).collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = collections.Counter()
    for i, x in SECRETS:
        x = x or ""
        kinds = {"assign": [m for m in assign.finditer(x) if len(m[2]) >= 12], "access": [m for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18], "hex": [m for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]}
        spans = sorted((m.start(), n, m.end(), k) for n, k in enumerate(kinds) for m in kinds[k])
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want[str((i, *[len(v) for v in kinds.values()], hashlib.sha256(told.encode()).hexdigest()))] += 1
    assert collections.Counter(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[6].spans == "owned:5:29" and by[6].n_live == 1
    assert by[20].spans == "" and by[20].n_copied == 1 and by[20].most_owners == 4
    assert secrets.digests(secrets.secret_spans(empty(spark))).count() == 0


def test_templates_and_examples(spark):
    """A value in four repositories of one owner is a template, one of three owners an example; one in three repositories is live."""
    token = {k: k * 8 + "a1" + k * 20 for k in "PQR"}
    rows = [(i, f"x {token['P']} y", f"l{i}", "one") for i in range(4)] + [(10 + i, f"x {token['Q']} y", "en", f"o{i}") for i in range(3)] + [(20 + i, f"x {token['R']} y", f"l{i % 3}", "one") for i in range(6)]
    got = {r.doc_id: (r.spans, r.most_owners, r.most_repos) for r in secrets.digests(secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert got[0] == ("", 1, 4) and got[10] == ("", 3, 3) and got[20] == ("owned:2:32", 1, 3)


def test_many_matches_in_one_text(spark):
    text = "\n".join(f"token={i:012d} é" for i in range(20_000))
    r = secrets.digests(secrets.secret_spans(made(spark, [(1, text)]))).first()
    assert r.n_assign == 20_000 and r.spans.split(",")[19_999] == f"assign:{19_999 * 21}:{19_999 * 21 + 18}"


def test_stages_hand_on_columns_of_any_name(spark):
    names = "_id long, _h string, _spans string, _th string, _cut string, _first string, _n int, _by string, _row string, h string, spans string, component_id string, n_shingles string, text_hash string, n_tokens string, bin_id string"
    kinds = [x.split() for x in names.split(", ")]
    rows = [(1, f"key {KEY}"), (2, "one two three four five six"), (2, "one two three four five six"), (3, "One two three four five six"), (None, "x"), (4, None)]
    docs = spark.createDataFrame([(i, t, *[7 if k != "string" else n for n, k in kinds]) for i, t in rows], "doc_id long, text string, " + names)
    out = secrets.redact(docs, secrets.secret_spans(docs))
    assert out.columns == docs.columns and {r.text for r in out.collect()} == {"key [SECRET]", rows[1][1], rows[3][1], "x", None}
    assert all(r._th == "_th" and r._id == 7 for r in out.collect())
    once = filters.first_of_near_duplicates(docs)
    assert once.columns == docs.columns and sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "4", "None"]
    assert packing.best_fit(packing.counted_by(docs, packing.word_count())).count() == 6


def test_redaction(spark):
    docs = made(spark, SECRETS)
    out = secrets.redact(docs, secrets.secret_spans(docs))
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[0] == "[SECRET]' and [SECRET] then [SECRET]" and by[3] is None and by[4] == "" and by[6] == "live [SECRET] x" and "Qq7" in by[20]
    span = "struct<start:int,rank:int,stop:int,kind:string,value:string>"
    two = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    cuts = two.selectExpr("doc_id", "xxhash64(text) AS h", f"cast(array(struct(1, 0, 4, 'a', ''), struct(3, 0, 6, 'b', ''), struct(6, 0, 7, 'c', '')) AS array<{span}>) AS spans")
    assert secrets.redact(two, cuts, "*").first().text == "0**789"


# --- 6 ---

TALK = [
    (1, 0, "u", "Hello there my good friend.\n\nHow are you doing today?"), (1, 1, "a", "On Monday X wrote:\n> Hello there, my good friend.\nI am fine thanks a lot indeed"),
    (1, 2, "u", "> > Hello there, my good friend.\n> I am fine thanks a lot indeed\nGood to know that for sure"), (1, 3, "u", "no quote at all in here"), (1, 4, "a", ">How are you\n>doing today?\nFine I say again"),
    (2, 0, "u", None), (2, 1, "a", ""), (2, 1, "a", ""), (None, 1, "u", "> hello there my good friend"), (3, None, "u", "> x"), (3, 5, "a", "> quoted from nowhere at all\nreply"),
]


def talk(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in TALK], "conv_id long, turn long, role string, text string, level int, hash string")


def test_quote_links(spark):
    got = {(r.conv_id, r.turn): r for r in quote_links.link_quotes(talk(spark)).collect()}
    assert [got[1, t].parent for t in range(5)] == [None, 0, 1, None, 0]
    assert [got[1, t].thread for t in range(5)] == [0, 0, 0, 3, 0] and [got[1, t].depth for t in range(5)] == [0, 1, 2, 0, 1]
    assert got[1, 2].links == 2 and got[1, 1].own_text == "I am fine thanks a lot indeed" and got[None, 1].own_text == "" and got[3, 5].parent is None
    assert quote_links.link_quotes(talk(spark)).count() == len(TALK)
    assert quote_links.link_quotes(talk(spark).limit(0)).count() == 0


def threads(seed, turns=40, conversations=3):
    """Messages of few different lines that quote earlier ones, wholly, in part and nested."""
    rng = random.Random(seed)
    lines = [f"this is the common line number {i}" for i in range(6)] + ["ok", "thanks a lot"]
    out = []
    for c in range(conversations):
        said = []
        for t in range(turns):
            own = [rng.choice(lines) if rng.random() < 0.8 else f"a line of its own {c} {t}" for _ in range(rng.randint(1, 3))]
            quotes = []
            for _ in range(rng.choice((0, 1, 1, 2)) if said else 0):
                mark = "> " * rng.randint(1, 2)
                quotes += [mark + x for x in rng.choice(said)[: rng.randint(1, 3)]] + [rng.choice(("", mark.strip()))]
            out.append((c, t, "u", "\n".join([*quotes, *own])))
            said.append(own)
    return out


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_quote_links_of_common_lines_against_sql(spark, hot, monkeypatch):
    import duckdb
    import pandas as pd

    from nightloom.llm import oracle

    monkeypatch.setattr(quote_links, "HOT", hot)
    monkeypatch.setattr(quote_links, "BLOCK", 7)
    rows = threads(hot)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    want = sorted(map(str, con.execute(f"SELECT conv_id::BIGINT, turn::BIGINT, own_text, parent::BIGINT, links, thread::BIGINT, depth FROM ({oracle.OP6})").fetchall()))
    got = quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "own_text", "parent", "links", "thread", "depth").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_turns_that_all_quote_one_line(spark):
    """As many rows as turns, not as pairs of turns."""
    n = 3000
    rows = [(1, t, "u", "> the one line of all of them\nthe one line of all of them") for t in range(n)]
    messages = quote_links.common.keyed(spark.createDataFrame(rows, "conv long, turn long, role string, text string"), "conv", "turn", "role", "text")
    got = {r.turn: (r.parent, r.links) for r in quote_links.parents(messages).collect()}
    assert got == {t: (t - 1, t) for t in range(1, n)}


def test_short_quotes_and_quoted_paragraphs(spark):
    rows = [
        (1, 0, "Sounds good"), (1, 1, "Yes"), (1, 2, "> Sounds good\nThen let us start"), (1, 3, "> Then let us start\nFine"), (1, 4, "> Yes\nReally?"),
        (2, 0, "One two three four\nfive six seven.\n\nEight nine ten eleven\ntwelve thirteen.\n\nThe end of it"), (2, 1, "Thanks!\n\nAnother thing"),
        (2, 2, "> One two three four five\n> six seven.\n>\n> Eight nine ten eleven twelve\n> thirteen.\nSo it is"), (2, 3, "> so here is something else\n> Thanks!\nNo"), (2, 4, "> ...\nNo"),
    ]
    got = {(r.conv_id, r.turn): r for r in quote_links.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent for t in range(5)] == [None, None, 0, 2, 1] and got[1, 3].thread == 0
    assert [got[2, t].parent for t in range(5)] == [None, None, 0, None, None]  # a short line of both is no evidence


def test_quote_links_against_sql(spark):
    import duckdb
    import pandas as pd

    from nightloom.llm import oracle

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame([r for r in TALK if r[0] is not None and r[1] is not None], columns=["conv_id", "turn", "role", "text"]))
    want = sorted(map(str, con.execute(f"SELECT conv_id::BIGINT, turn::BIGINT, own_text, parent::BIGINT, links, thread::BIGINT, depth FROM ({oracle.OP6})").fetchall()))
    got = quote_links.link_quotes(talk(spark).where("conv_id IS NOT NULL AND turn IS NOT NULL")).select("conv_id", "turn", "own_text", "parent", "links", "thread", "depth").collect()
    assert sorted(str(tuple(r)) for r in got) == want


# --- 7 ---


def brute_mixture(order, texts, learned, kept):
    """log10 probability of each text: all estimates and weights anew, from dictionaries, on the same grid."""
    model = deleted_interpolation

    def counts(some):
        grams = collections.Counter()
        for w in some:
            for i in range(len(w)):
                for k in range(1, order + 1):
                    own = ("^",) * max(0, k - 1 - i) + tuple(w[max(0, i - k + 1) : i + 1])
                    grams[own] += 1
        return grams, sum(len(w) for w in some), len({x for w in some for x in w}), len(some)

    def tokens(w, found):
        grams, n, v, texts_ = found
        for i in range(len(w)):
            likely, bucket = [grams[(w[i],)] / max(n, 1)], []
            for k in range(2, order + 1):
                own = ("^",) * max(0, k - 1 - i) + tuple(w[max(0, i - k + 1) : i + 1])
                context = texts_ if i == 0 else grams[own[:-1]]
                likely.append(min(grams[own] / max(context, 1), 1))
                bucket.append(min(int(math.log2(context + 1)), model.BUCKETS - 1))
            yield likely, bucket

    def mixed(likely, bucket, weights, v):
        a, b, c = weights[0][bucket[0]]
        p = a * likely[1] + b * likely[0] + c / (v + 1)
        for k, w in enumerate(weights[1:], 1):
            a, b = w[bucket[k]]
            p = a * likely[k + 1] + b * p
        return p

    rest = counts([w for w, l, h in zip(texts, learned, kept, strict=True) if l and not h])
    held = [t for w, h in zip(texts, kept, strict=True) if h for t in tokens(w, rest)]
    weights = []
    for k in range(1, order):
        at = lambda p: model.VALUES[int(model.level(np.array([p]))[0])]
        rows = collections.Counter()
        for likely, bucket in held:
            below = likely[0] if k == 1 else mixed(likely, bucket, weights, rest[2])
            rows[(bucket[k - 1], at(likely[k]), at(below), *([1 / (rest[2] + 1)] if k == 1 else []))] += 1
        weights.append(model.expectation_maximisation(np.array([r[0] for r in rows], int), np.array([r[1:] for r in rows], float).reshape(len(rows), 3 if k == 1 else 2), np.array([*rows.values()], float)))
    full = counts([w for w, l in zip(texts, learned, strict=True) if l])
    return [sum(math.log10(mixed(*t, weights, full[2])) for t in tokens(w, full)) for w in texts]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_scores_by_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(deleted_interpolation, "BLOCK_TOKENS", 2000)
    rows = [(i, t) for i, t in corpus(3) if i is not None] + [(None, "kept apart"), (None, None)]
    docs = made(spark, rows)
    got = deleted_interpolation.language_scores(docs, parts=3, order=order).collect()
    assert len(got) == len(rows)
    low = lambda t: [w.lower() if w.isascii() else w for w in words(t)] + [b"\0end"]
    fold = lambda i, k: zlib.crc32(("" if i is None else str(i)).encode()) % k
    texts, folds = [low(t) for _, t in rows], [fold(i, 10) for i, _ in rows]
    one = collections.Counter(x for w, f in zip(texts, folds, strict=True) if f for x in w)
    n, v = sum(one.values()), len(one)
    scores = brute_mixture(order, texts, [f != 0 for f in folds], [f == 9 for f in folds])
    want = collections.Counter()
    for (i, _), w, f, p in zip(rows, texts, folds, scores, strict=True):
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[str((i, f == 0, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(p, 6)))] += 1
    assert collections.Counter(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))) for r in got) == want
    assert deleted_interpolation.language_scores(empty(spark), parts=2, order=order).count() == 0


def test_language_scores_without_training_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = deleted_interpolation.language_scores(made(spark, [(i, "some words") for i in ids]), 2).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 3


def test_language_scores_of_tables_without_an_order(spark, monkeypatch):
    """Rows that come in another order each time they are read: dealt anew, joined, limited."""
    monkeypatch.setattr(deleted_interpolation, "BLOCK_TOKENS", 1500)
    rows = [(i, t) for i, t in corpus(n=60) if i is not None]
    docs = made(spark, rows)
    key = lambda r: (r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 4))
    want = sorted(key(r) for r in deleted_interpolation.language_scores(docs, 3).collect())
    joined = docs.join(docs.select("doc_id").distinct().repartition(7), "doc_id").orderBy(F.rand())
    for other in (docs.repartition(6), joined, docs.repartition(5).limit(len(rows))):
        got = sorted(key(r) for r in deleted_interpolation.language_scores(other, 3).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-3)


def test_language_scores_of_a_table_united_with_itself(spark, tmp_path):
    made(spark, [(i, t) for i, t in corpus(3, 40) if i is not None]).coalesce(1).write.parquet(path := str(tmp_path / "once"))
    once = spark.read.parquet(path)
    twice = once.union(once)
    assert twice.rdd.getNumPartitions() == 2
    got = collections.defaultdict(list)
    for r in deleted_interpolation.language_scores(twice, 3).collect():
        got[r.doc_id, r.n_tokens].append((r.base_score, r.score))
    assert sum(map(len, got.values())) == 2 * once.count() and all(len(v) % 2 == 0 and len({round(s, 9) for _, s in v}) <= len(v) // 2 for v in got.values())


def test_mixture_weights_are_the_likeliest():
    rng = np.random.default_rng(0)
    p = np.column_stack([rng.random(400) * (rng.random(400) > 0.5), rng.random(400) * 0.1, np.full(400, 1e-3)])
    w = deleted_interpolation.expectation_maximisation(np.zeros(400, int), p, np.ones(400), 2000)[0]
    assert abs(w.sum() - 1) < 1e-9
    like = lambda w: np.log(p @ w).sum()
    for _ in range(200):
        other = np.abs(w + rng.normal(0, 0.02, 3))
        assert like(w) >= like(other / other.sum()) - 1e-3


def test_integers_survive_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (deleted_interpolation.unpack_keys(deleted_interpolation.pack_keys(x)) == x).all()
    assert len(deleted_interpolation.unpack_keys(deleted_interpolation.pack_keys(x[:0]))) == 0
    n = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 5])
    assert deleted_interpolation.unpack_numbers(deleted_interpolation.pack_numbers(n)).tolist() == n.tolist() and not len(deleted_interpolation.unpack_numbers(deleted_interpolation.pack_numbers(n[:0])))


# --- 8 ---


def test_packing(spark):
    rows = corpus(4) * 3
    got = packing.best_fit(packing.counted_by(made(spark, rows), packing.word_count()), shard_pieces=60).collect()
    whole = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.n
        bins[r.bin_id].append(r)
        assert r.bin_start + r.n <= r.bin_fill <= r.bin_size and r.bin_size in packing.SIZES
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(words(t)) + 1
    assert whole == want
    for own in bins.values():
        own.sort(key=lambda r: r.bin_start)
        at = 0
        for r in own:  # pieces stand one behind the other
            assert r.bin_start == at
            at += r.n
        assert at == own[0].bin_fill and own[0].bin_size == min(s for s in packing.SIZES if s >= at)
    assert packing.best_fit(packing.bpe_counts(empty(spark), TOKENIZER)).count() == 0


def brute_pack(lengths, menu):
    """Best fit by looking at every bin."""
    room, size, left = [], [], sum(lengths)
    for n in lengths:
        fits = [b for b, r in enumerate(room) if r >= n]
        if fits:
            b = min(fits, key=lambda b: room[b])
        else:
            b = len(room)
            size.append(min((s for s in menu if s >= n), key=lambda s: (packing.bin_cost(s) / min(s, left), s)))
            room.append(size[b])
        room[b] -= n
        left -= n
    return sorted(min(s for s in packing.SIZES if s >= z - r) for z, r in zip(size, room, strict=True))


@pytest.mark.parametrize("longest", [256, 900, 4096])
def test_best_fit_by_brute_force(longest):
    """Every menu's packing, and the choice of the cheapest, for short and for long pieces."""
    rng = random.Random(longest)
    lengths = sorted((rng.randint(1, longest) for _ in range(300)), reverse=True)
    costs = {}
    for menu in packing.menus(packing.SIZES, lengths[0]):
        where, start, size = packing.pack(lengths, menu=menu)
        assert sorted(size.tolist()) == brute_pack(lengths, menu)
        costs[menu] = sum(packing.bin_cost(s) for s in size.tolist())
    where, start, size = packing.pack_jointly(lengths)
    assert math.isclose(sum(packing.bin_cost(s) for s in size.tolist()), min(costs.values()))
    assert len({*costs.values()}) > 1 and sum(size.tolist()) >= sum(lengths)
    assert packing.pack_jointly([])[2].tolist() == []


def test_sequences_hold_every_document(spark):
    """Token ids of the bins, taken apart at the pieces, give back all texts."""
    rows = [*corpus(6, 30), (500, "long text é " * 3000), (501, None), (501, None)]
    docs = made(spark, rows)
    packed = packing.best_fit(packing.bpe_counts(docs, TOKENIZER), shard_pieces=40)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    bins = {r.bin_id: r for r in packing.sequences(docs, packed, TOKENIZER, 50256).collect()}
    parts = collections.defaultdict(list)
    for r in packed.collect():
        own = bins[r.bin_id]
        assert len(own.ids) == r.bin_fill <= own.bin_size == r.bin_size and r.bin_start in own.starts
        parts[r.doc_id, r.text_hash, r.piece].append(own.ids[r.bin_start : r.bin_start + r.n])
    codec, back = bpe.codec(TOKENIZER), collections.Counter()
    for i, h in {k[:2] for k in parts}:
        for one in zip(*[v for k, v in sorted(parts.items(), key=lambda x: x[0][2]) if k[:2] == (i, h)], strict=True):
            ids = [x for piece in one for x in piece]
            assert ids[-1] == 50256
            back[i, codec.decode(ids[:-1])] += 1
    assert back == collections.Counter((i, t or "") for i, t in rows)


# --- 9 ---


@pytest.mark.skipif(importlib.util.find_spec("tokenizers") is None, reason="no tokenizers")
def test_bpe_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, rng = bpe.codec(TOKENIZER), random.Random(5)
    lib = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    letters = [chr(x) for x in (*range(0, 0x250), *range(0x2000, 0x2040), 0x3042, 0x1F600, 0xFEFF)] + list(" \nab") * 40
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(300)] + [t or "" for _, t in corpus()] + ["a<|endoftext|> b", "aaaaaaaa", "don't I'LL", " \n\n x"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False) and own.counts([t]) == [len(ids)]
    small = bpe.Codec(str(public_tokenizers.path(TOKENIZER)), remember=1000)  # a table that is always full
    assert [small.encode(t) for t in texts[-80:]] == [own.encode(t) for t in texts[-80:]] and small.counts(texts[:80]) == own.counts(texts[:80])
    docs = made(spark, corpus())
    got = {(r.doc_id, r.n_tokens) for r in bpe.digests(docs, TOKENIZER).collect()}
    assert got == {(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus()}
    back = {r.doc_id: r.text for r in bpe.decode_column(bpe.encode_column(docs, TOKENIZER), TOKENIZER).collect()}
    assert all(back[i] == (t or "") for i, t in corpus() if i is not None)
    assert bpe.digests(empty(spark), TOKENIZER).count() == 0


# --- shared ---


def test_checkpoints_and_batches(spark):
    class Conf(dict):
        getAll = property(lambda self: dict(self))
        set = dict.__setitem__

    class Session:
        conf = Conf()

        class sparkContext:
            master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert common.checkpoint_dir(Session) == "hdfs:///shared"
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.bounded_batches(Session)
    assert Session.conf[name] == str(common.BATCH_BYTES)
    Session.conf[name] = "1000"
    common.bounded_batches(Session)
    assert Session.conf[name] == "1000"
    assert common.unused(["_ID", "_id_", "x"], "_id", "x", "y") == ["_id__", "x_", "y"]


# --- pipeline ---


def test_pipeline_filters(spark):
    rows, quality, toxic = labelled()
    docs = made(spark, [*rows, (900, None), (None, rows[1][1]), (901, rows[2][1]), (2, rows[2][1])])
    q = compression_quality.quality_model(docs, spark.createDataFrame(quality, "doc_id long, quality int"))
    t = toxicity.toxicity_model(docs, spark.createDataFrame(toxic, "doc_id long, toxic int"))
    for out in (filters.good(docs, q), filters.not_toxic(docs, t)):
        assert out.schema == docs.schema
    assert {r.doc_id for r in filters.not_toxic(docs, t).collect()} >= {i for i, y in toxic if not y}
    once = filters.first_of_near_duplicates(docs)
    assert once.columns == docs.columns
    ids = [r.doc_id for r in once.collect()]
    kept = {c for i, _, c in brute_components([*rows, (900, None), (901, rows[2][1])])}
    assert collections.Counter(i for i in ids if i is not None) == collections.Counter(kept) and ids.count(None) == 1


def test_pipeline_by_brute_force(spark, tmp_path):
    """All five stages on repeated rows, ties, nulls and copies: each stage's rows from the rows that the one before kept."""
    import corpus_pipeline

    rows, quality, toxic = labelled()
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(5, rows[5][1]), (5, rows[5][1]), (6, rows[7][1]), (900, None), (901, ""), (None, rows[2][1]), (None, rows[2][1])]
    mixed = lambda k: " ".join(x for i in range(k, k + 60, 3) if i % 4 != 1 for x in rows[i + (i % 3 == 0)][1].split()[k % 5 :: 5])
    rows += [(300, f"{mixed(1)} password = abcdefghijkl12"), (301, f"{mixed(22)} {KEY} x"), (302, f"{mixed(43)} live Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9 x"), (303, " ".join(rows[i][1] for i in range(160) if i % 3 and i % 4 != 1))]
    d = str(tmp_path)
    made(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, t) for (i, q), (_, t) in zip(quality, toxic, strict=True)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    told = lambda found: collections.Counter((r.doc_id, r.text) for r in found)
    at, stage = docs, dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal at
        out = stage[name](spark, at, d)
        out.write.parquet(path := f"{d}/{name}")
        before, at = at.collect(), spark.read.parquet(path)
        return before, at.collect()

    judge = toxicity.toxicity_model(docs, labels, corpus_pipeline.learns())
    before, after = step("toxicity")
    assert told(after) == told(r for r in before if judge.scores([(r.text or "").encode()])[0] < 0.5)
    judge = compression_quality.quality_model(at, labels, corpus_pipeline.learns())
    before, after = step("quality")
    assert told(after) == told(r for r in before if judge.scores([(r.text or "").encode()])[0] >= 0.3)
    before, after = step("near_duplicates")
    root = dict((i, c) for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80))
    assert told(after) == told({(r.doc_id, r.text): r for r in before if r.doc_id is not None and root[r.doc_id] == r.doc_id}.values()) + told(r for r in before if r.doc_id is None)
    assert len(after) < len(before) - 8
    before, after = step("secrets")
    want = collections.Counter()
    for r in before:
        x = (r.text or "").replace("password = abcdefghijkl12", "[SECRET]").replace(KEY, "[SECRET]").replace("Zz9" * 8, "[SECRET]")
        want[r.doc_id, None if r.text is None else x] += 1
    assert not [(x[0], x[1][-60:], n) for x, n in ((told(after) - want) + (want - told(after))).items()]
    assert all(r.n_chars == len(r.text) for r in after if r.text) and told(after) != told(before)
    before, after = step("packing")
    tokens = bpe.codec(TOKENIZER)
    whole = collections.Counter()
    for r in after:
        whole[r.doc_id] += r.n
    want = collections.Counter()
    for r in before:
        want[r.doc_id] += len(tokens.encode(r.text or "")) + 1
    assert whole == want
    fill = collections.Counter()
    for r in after:
        fill[r.bin_id] += r.n
    assert all(fill[r.bin_id] == r.bin_fill <= r.bin_size for r in after)
    assert corpus_pipeline.run(spark, d).count() == len(after)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, quality, toxic = labelled()
    d = str(tmp_path)
    made(spark, [*rows, (900, None), (901, "")]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, t) for (i, q), (_, t) in zip(quality, toxic, strict=True)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d)
    packed = {r.doc_id for r in out.collect()}
    assert packed >= {i for (i, q), (_, t) in zip(quality, toxic, strict=True) if q and not t}
    assert not packed & {i for i, t in toxic if t}
    none = str(tmp_path / "none")
    empty(spark).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
