"""Operators 1, 3, 4, 6, 7 and 10 against plain versions, and on odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenry.llm import graph, jaccard_join, language_id, license_scan, lm_score, mixing, packing, wordhash

from . import plain

DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, " \n "), (905, "x" * 100_000), (902, "a b"), (None, "a b"), (906, "ab " * 30_000), (907, "é\u00a0ü ß")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbß \t\n\x0b\x1c\u2003", max_size=30)), max_size=8))
def test_word_hashes_agree_with_words(texts):
    import pyarrow as pa

    hashed, first = wordhash.words(pa.array(texts, pa.large_string()))
    named = [w for t in texts for w in plain.words(t)]
    assert np.diff(first).tolist() == [len(plain.words(t)) for t in texts]
    assert len(set(zip(named, hashed.tolist()))) == len(set(named)) == len(set(hashed.tolist()))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)]
    linked = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    expected = plain.components(len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in linked, nodes)
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(rows(found)) == dict(zip(nodes, expected))
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("most", [3, 16, 1_000])
def test_components_over_several_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "LOCAL_EDGES", most)
    rng = random.Random(most)
    path = rng.sample(range(-60, 60), 90)
    edges = [*zip(path, path[1:]), (500, 400), (400, 500), (700, 700), (5000, 700), *((1000, 1000 + k) for k in range(1, 30))]
    rng.shuffle(edges)
    linked = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    expected = plain.components(len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in linked, nodes)
    found = graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5))
    assert sorted(map(tuple, found.collect())) == sorted(zip(nodes, expected))


def test_components_take_few_jobs(spark):
    """Every join that the driver plans and every table that it sends costs it memory: components of few edges take no joins."""

    def last_job(group):
        spark.sparkContext.setJobGroup(group, group)
        spark.sparkContext.range(1).count()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    before = last_job("before components")
    assert graph.components(edges).where("comp = 0").count() == 301
    assert last_job("after components") - before < 12


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 0.5), (5, 80, 0.1)])
def test_jaccard_join(spark, width, percent, hot):
    data = plain.near_copies(1, 500, hot) + ODD
    found = jaccard_join.jaccard_components(spark.createDataFrame(data, DOCS), width=width, percent=percent)
    expected = plain.jaccard(data, width, percent)
    if percent == 85:
        assert rows(found) == expected
    else:
        assert rows(found) == expected and len({c for _, _, c in expected}) < len(data)


def test_jaccard_join_long_lists(spark, monkeypatch):
    """Lists long enough for blocks of their own, in several blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL_LIST", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    data = plain.near_copies(2, 250, 0.7, sizes=(60, 120), edits=(1, 2, 4, 6, 9))
    found = jaccard_join.jaccard_components(spark.createDataFrame(data, DOCS), width=4, percent=85)
    assert rows(found) == plain.jaccard(data, 4, 85)


def test_jaccard_join_on_nothing(spark):
    empty = spark.createDataFrame([], DOCS + ", cid int, bits int, n int")
    assert jaccard_join.jaccard_components(empty).columns == ["doc_id", "n_shingles", "component_id"] and jaccard_join.jaccard_components(empty).isEmpty()


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_packing_plan_is_exact(histogram):
    held = Counter()
    for items, use in sum(packing.plan(histogram, 64), []):
        assert use > 0 and sum(n * a for n, a in items.items()) <= 64
        for n, a in items.items():
            held[n] += a * use
    assert held == Counter(histogram)


def test_packing_plan_is_tight():
    rng = np.random.default_rng(2)
    u, c = np.unique(rng.integers(1, 1025, 20_000), return_counts=True)
    solved, rest = packing.plan(dict(zip(u.tolist(), c.tolist())), 1024)
    used = sum(use for _, use in solved + rest)
    assert used <= 1.004 * -(-int(u @ c) // 1024)
    full = sum(use for items, use in solved if items == {1024: 1})
    assert sum(use for _, use in solved) - full >= 0.8 * (used - full)


def test_tokens_of_long_blanks():
    from tokenizers import Tokenizer

    from lumenry.llm import tokens

    exact, own = Tokenizer.from_file(packing.default_vocabulary()), tokens.ByteBpe(packing.default_vocabulary())
    for text in ("a" + " " * 2_000_000 + "b", "one two  three\n" * 200_000):
        got = np.concatenate(list(own.parts(text, 2)))
        assert got.tolist() == [*exact.encode(text, add_special_tokens=False).ids, 2]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    data = plain.near_copies(3, 60) + ODD + [(950, "Hello  world\n\n x <|endoftext|> don't\t 漢字 🎉"), (951, "word " * 1023), (952, "word " * 2046)]
    df = spark.createDataFrame(data, DOCS).withColumn("length", F.lit(1)).withColumn("part", F.lit("x"))
    found = packing.pack(df, packing.default_vocabulary())
    expected = []
    for i, text in data:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = found.collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(expected, key=str)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, [*own[1:], (sum(n for _, n in own), 0)])) and own[0][0] == 0
        assert sum(n for _, n in own) <= 1024
    assert packing.pack(df.limit(0), packing.default_vocabulary()).isEmpty()


def test_license_scan(spark):
    notice = license_scan.TEMPLATES["MIT-permission"]
    data = [(1, f"some text\n{notice}, and more"), (2, notice.upper().replace("CHARGE", "COST")), (3, "licensed under nothing at all"), (4, "word " * 50_000 + "Released under the MIT License."), *ODD]
    found = license_scan.scan(spark.createDataFrame(data, DOCS + "").withColumn("licenses", F.lit(1)))
    best = {r["doc_id"]: [(s["license"], round(s["dice"], 3), s["start"]) for s in r["licenses"]] for r in found.collect()}
    assert best[1] == [("MIT-permission", 1.0, 2)] and best[3] == [] and best[4] == [("MIT", 1.0, 50_000)]
    assert best[2][0][0] == "MIT-permission" and 0.8 <= best[2][0][1] < 1
    assert found.count() == len(data) and license_scan.scan(spark.createDataFrame([], DOCS)).isEmpty()


def test_license_dice_against_plain(spark):
    """The best coefficient of a window equals that of a search over all windows."""
    rnd = random.Random(6)
    template = "this work may be copied and shared by anyone and shared by all under the same terms".split()
    known = license_scan.Templates({"t": " ".join(template)})
    grams = lambda w: list(zip(w, w[1:]))
    own, data, expected = set(grams(template)), [], {}
    for k in range(60):
        w = list(template)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "zzz"
        w = [f"p{rnd.randrange(9)}" for _ in range(rnd.randrange(30))] + w + [f"q{rnd.randrange(9)}" for _ in range(rnd.randrange(30))]
        g = grams(w)
        n = len(template) - 1
        best = max((2 * len(own & set(g[a : a + n])) / (len(own) + len(set(g[a : a + n]))) for a in range(len(g)) if g[a] in own), default=0)
        data.append((k, " ".join(w)))
        expected[k] = round(best, 9) if best >= 0.6 else None
    found = license_scan.scan(spark.createDataFrame(data, DOCS), least=0.6, templates={"t": " ".join(template)})
    got = {r["doc_id"]: round(r["licenses"][0]["dice"], 9) if r["licenses"] else None for r in found.collect()}
    assert got == expected and len(known.known) == len(own)


def test_license_windows_of_any_length(spark):
    """Words put in or left out in mid-text do not hide a notice; the best coefficient is that over all windows."""
    middle = "some words before this work is hereby also licensed under the gnu general public license version 3 and many other words after it"
    found = license_scan.scan(spark.createDataFrame([(1, middle)], DOCS), any_length=True).first()["licenses"]
    assert [(s["license"], round(s["dice"], 3), s["start"], s["words"]) for s in found] == [("GPL-3.0", 0.842, 8, 9)]
    rnd = random.Random(8)
    template = "this work may be copied and shared by anyone and shared by all under the same terms".split()
    grams = lambda w: list(zip(w, w[1:]))
    own, data, expected = set(grams(template)), [(900, None), (901, ""), (902, "this work " * 3000)], {900: None, 901: None, 902: None}
    for k in range(80):
        w = list(template)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(2)] = rnd.choice([["zzz"], [], ["yyy", "zzz"], w[at : at + 1] * 2])
        w = [f"p{rnd.randrange(9)}" for _ in range(rnd.randrange(20))] + w + [f"q{rnd.randrange(9)}" for _ in range(rnd.randrange(20))]
        g = grams(w)
        best = max(2 * len(own & set(g[a:b])) / (len(own) + len(set(g[a:b]))) for a in range(len(g)) for b in range(a + 1, len(g) + 1))
        data.append((k, " ".join(w)))
        expected[k] = round(best, 9) if best >= 0.6 else None
    found = license_scan.scan(spark.createDataFrame(data, DOCS), least=0.6, templates={"t": " ".join(template)}, any_length=True)
    assert {r["doc_id"]: round(r["licenses"][0]["dice"], 9) if r["licenses"] else None for r in found.collect()} == expected


LETTERS = {"aa": "abcde", "bb": "cdefgh", "cc": "ghijk", "dd": "éèàkl"}


def speech(seed, count):
    rnd = random.Random(seed)
    out = []
    for k in range(count):
        lang = rnd.choice(list(LETTERS))
        out.append((k, " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(5)) for _ in range(20)), lang))
    return out


def test_language_id(spark):
    df = spark.createDataFrame(speech(1, 300) + [(1000, None, "aa"), (1001, "abc", None)], DOCS + ", lang string")
    model = language_id.train(df.where(~language_id.is_held_out()))
    assert model.languages == ["aa", "bb", "cc", "dd"]
    test = spark.createDataFrame([*speech(2, 100), *[(i, t, None) for i, t in ODD], (1002, "12 !", None)], DOCS + ", lang string").withColumn("language", F.lit(1))
    found = language_id.identify(test, model, out_col="found").select("doc_id", "lang", "found.*").collect()
    own = [r for r in found if r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in own]) > 0.97 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {900, 901, 904, 1002}
    untaught = language_id.train(df.limit(0))
    assert {r["language"]["lang_pred"] for r in language_id.identify(test.drop("language"), untaught).collect()} == {"und"}
    one = language_id.train(df.where("lang = 'aa'"))
    assert language_id.identify(df.where("doc_id < 3"), one).select("language.lang_pred").distinct().count() == 1


def test_language_id_of_many_languages_and_long_texts(spark):
    """Forty languages of letter pairs of their own; a text of many slices is read whole."""
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = [[rnd.choice(letters) + rnd.choice(letters) for _ in range(12)] for _ in range(40)]
    text = lambda k, n: " ".join(rnd.choice(pairs[k]) + rnd.choice(pairs[k]) for _ in range(n))
    data = [(k * 100 + n, text(k, 60), f"l{k:02}") for k in range(40) for n in range(6)]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string").select("lang", "text"))
    asked = [(k, text(k, 60)) for k in range(40)] + [(100, text(3, 10) + " " + text(7, 120_000))]
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in language_id.identify(spark.createDataFrame(asked, DOCS), model).collect()}
    assert sum(got[k] == f"l{k:02}" for k in range(40)) >= 38 and got[100] == "l07"


def test_codewords_keep_their_distance():
    for count in (2, 3, 4, 7, 9, 20):
        code = language_id.codewords(count).astype(int)
        gap = min((code[a] != code[b]).sum() for a in range(count) for b in range(a))
        assert code.shape[0] == count and gap >= (1 if count == 2 else 2 if count == 3 else 4)
        assert (np.abs(code.sum(0)) < count).all()


def targets(totals, most=3):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, held, stopped = sum(totals.values()), {}, set()
    while True:
        rest = total - sum(most * totals[s] for s in stopped)
        share = sum(weight[s] for s in names if s not in stopped)
        held = {s: most * totals[s] if s in stopped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in stopped and held[s] > most * totals[s] * (1 + 1e-12)}
        if not over:
            return held
        stopped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "c", None, "tiny", "hot"]
    data = [(k, " ".join("w" for _ in range(rnd.randrange(200))), rnd.choice(names[:4] + ["hot"] * 4)) for k in range(600)]
    data += [(2000, "two words", "tiny"), (2001, None, "a"), (2002, "", None), (2001, None, "a"), (None, "x y z", "b")]
    df = spark.createDataFrame(data, DOCS + ", source string").withColumn("mix", F.lit(1)).withColumn("goal", F.lit(2)).withColumn("took", F.lit(3))
    out = mixing.mix(df, out_col="out").select("doc_id", "source", "mix", "out.*").collect()
    assert len(out) == len(data)
    totals = Counter()
    for _, text, source in data:
        totals[source] += len(plain.words(text))
    goal = targets(totals)
    taken = Counter()
    for r in out:
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["mix"] == 1
        taken[r["source"]] += r["taken"]
    for source in totals:
        assert abs(taken[source] - goal[source]) <= 10
    again = mixing.mix(df.repartition(7), out_col="out").select("doc_id", "out.taken")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["taken"]) for r in out)
    assert mixing.mix(df.limit(0), out_col="out").isEmpty()


def test_mixing_goes_by_the_tree(spark):
    """Copies name shards; what a block in part gives depends on its shard, and repeated rows are given alike."""
    rnd = random.Random(6)
    data = [(k, " ".join("w" for _ in range(rnd.randrange(1, 90))), "abc"[k % 3]) for k in range(900)] + [(5000, "x y", "a")] * 40
    df = spark.createDataFrame(data, DOCS + ", source string")
    plainly = {s: spark.createDataFrame(data, DOCS + ", source string") for s in (7, 8)}
    rows = mixing.mix(df).collect()
    copies = [c for r in rows for c in r["mix"]["copies"]]
    assert all(c["words"] > 0 and 0 <= c["place"] < 1 for c in copies if c["words"]) and all(sum(c["words"] for c in r["mix"]["copies"]) == r["mix"]["taken"] for r in rows)
    assert len({r["mix"]["taken"] for r in rows if r["doc_id"] == 5000}) == 1
    taken = [{r["doc_id"]: r["mix"]["taken"] for r in mixing.mix(own, seed=s).collect()} for s, own in plainly.items()]
    assert taken[0] != taken[1]


def test_splitting_tree_with_groups_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    monkeypatch.setattr(mixing, "STRETCH", 5)
    quota = spark.createDataFrame([(f"s{k}", 5 + k) for k in range(20)] + [(None, 7)], "source string, units long")
    runs, size = mixing.split_quotas(quota, 3, 2).collect(), Counter()
    for r in runs:
        size[r["shard"]] += r["hi"] - r["lo"]
    assert sum(size.values()) == sum(5 + k for k in range(20)) + 7 and max(size.values()) - min(size.values()) <= 1
    for source in [f"s{k}" for k in range(20)] + [None]:
        own = sorted((r["lo"], r["hi"]) for r in runs if r["source"] == source)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_splitting_tree(spark):
    """Shards are even, quotas exact, and draws have the hypergeometric mean and variance."""
    quota = spark.createDataFrame([("a", 400), ("b", 1000), (None, 60), ("none", 0)], "source string, units long")
    held = [r for seed in range(120) for r in mixing.split_quotas(quota, 1, seed).collect()]
    left = np.array([r["hi"] - r["lo"] for r in held if r["source"] == "a" and r["shard"] == 0])
    mean, variance = 730 * 400 / 1460, 730 * (400 / 1460) * (1060 / 1460) * (730 / 1459)
    assert abs(left.mean() - mean) < 4 * np.sqrt(variance / len(left)) and 0.6 < left.var() / variance < 1.6
    runs = mixing.split_quotas(quota, 3, 1).collect()
    size = Counter()
    for r in runs:
        size[r["shard"]] += r["hi"] - r["lo"]
    assert sum(size.values()) == 1460 and set(size.values()) <= {182, 183}
    for source, units in (("a", 400), ("b", 1000), (None, 60)):
        own = sorted((r["lo"], r["hi"]) for r in runs if r["source"] == source)
        assert own[0][0] == 0 and own[-1][1] == units and all(a[1] == b[0] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize(("chunk", "bucket"), [(40, 64), (700, 16), (1 << 19, 1 << 20)])
def test_lm_score(spark, monkeypatch, chunk, bucket):
    """Against plain models over all words and pairs, each document's own counts left out, whatever the chunks."""
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(lm_score, "BUCKET_KEYS", bucket)
    rnd = random.Random(3)
    data = [(k, " ".join(rnd.choice("abcdefghij" if k % 2 else "fghijklmno") + rnd.choice(["", "", str(rnd.randrange(40))]) for _ in range(30))) for k in range(80)] + ODD
    chosen = [k for k in range(40) if k % 2]
    df = spark.createDataFrame(data, DOCS).withColumn("chunk", F.lit(1)).withColumn("chosen", F.lit("x"))
    found = rows(lm_score.score(df, spark.createDataFrame([(k,) for k in [*chosen, None, 1]], "doc_id long")))
    texts = [(i, plain.words(t)) for i, t in data]
    kinds = len({w for _, ws in texts for w in ws}) + 1
    models = []
    for part in ([ws for i, ws in texts if i in chosen], [ws for _, ws in texts]):
        seqs = [[0, *ws, 1] for ws in part if ws]
        models.append((Counter(x for q in seqs for x in q), Counter(p for q in seqs for p in zip(q, q[1:])), sum(len(q) - 1 for q in seqs)))
    scale = models[0][2] / models[1][2]
    want = []
    for i, ws in texts:
        losses = []
        for k, (alone, pairs, size) in enumerate(models):
            times, r, q = int(k == 1 or i in chosen), (1, scale)[k], [0, *ws, 1]
            own, own_pairs = Counter(q), Counter(zip(q, q[1:]))
            of = lambda w: (r * (alone[w] - times * own[w]) + 0.5) / (r * (size - times * (len(ws) + 1)) + 0.5 * kinds)  # noqa: E731, B023
            chance = lambda v, w: (r * (pairs[v, w] - times * own_pairs[v, w]) + 5 * of(w)) / (r * (alone[v] - times * own[v]) + 5)  # noqa: E731, B023
            losses.append(-np.mean([np.log(chance(v, w)) for v, w in zip(q, ws)]) if ws else None)
        want.append((i, len(ws), *losses, losses[0] - losses[1] if ws else None))
    found.sort(key=lambda r: str(r[:2]))
    want.sort(key=lambda r: str(r[:2]))
    assert len(found) == len(data)
    for got, exact in zip(found, want):
        assert got[:2] == exact[:2] and (got[2] is None) == (exact[2] is None)
        assert exact[2] is None or np.allclose(got[2:], exact[2:], atol=1e-9)
    assert lm_score.score(df.limit(0), df.limit(0).select("doc_id")).isEmpty()
    assert all(r[2] is not None or not r[1] for r in rows(lm_score.score(df, df.limit(0).select("doc_id"))))


def test_lm_score_does_not_tell_what_was_learned(spark):
    """Documents of one kind score alike, whether the target model was learned from them or not; other kinds score higher."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    chains = [{w: [rnd.choice(words) for _ in range(6)] for w in words} for _ in range(2)]

    def text(kind):
        out = [rnd.choice(words)]
        while len(out) < 150:
            out.append(rnd.choice(chains[kind][out[-1]]))
        return " ".join(out)

    data = [(k, text(k % 4 == 3)) for k in range(800)]
    kind = {k: k % 4 == 3 for k in range(800)}
    trained = [k for k in range(800) if kind[k] and k % 8 == 3]
    score = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(data, DOCS), spark.createDataFrame([(k,) for k in trained], "doc_id long")).collect()}
    one, two = (np.median([score[k] for k in score if kind[k] and (k in trained) == x]) for x in (True, False))
    assert abs(one - two) < 0.05 and np.median([score[k] for k in score if not kind[k]]) > two + 0.5


def test_jaccard_join_of_long_texts(spark):
    """Sets on both sides of a bitmap length."""
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, data = [rnd.choice(vocabulary) for _ in range(1035)], []
    for k in range(60):
        own = list(base)
        for _ in range(rnd.randrange(60)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        data.append((k, " ".join(own[: rnd.randrange(990, 1036)])))
    found = jaccard_join.jaccard_components(spark.createDataFrame(data, DOCS), width=4, percent=85)
    assert rows(found) == plain.jaccard(data, 4, 85)


def test_jaccard_join_through_a_row_without_id(spark):
    """1 and 3 are linked only by a text that no id holds."""
    words = [f"w{k}" for k in range(100)]
    data = [(1, " ".join(words)), (None, " ".join(words[4:])), (None, " ".join(words[4:])), (3, " ".join(words[8:]))]
    found = jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), width=5, percent=95)
    assert rows(found) == sorted([(1, 96, 1), (None, 92, None), (None, 92, None), (3, 88, 1)], key=str)
