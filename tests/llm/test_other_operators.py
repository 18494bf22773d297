"""Operators 2, 5, 8 and 9, and the pipeline, against plain versions and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenry.llm import cap_filters, jaccard_join, language_id, mixing, projection_search, url_filter, warc
from lumenry.llm.store import fresh, materialise, workdir

from . import plain


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    return host, m[2] if m else ""


def rule_of(host, path):
    fits = []
    for action, rule in url_filter.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_parts(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x=/a://b", "http://a.example.com/en/8#t", "https://xexample.com/en/7", "http://example.net/de/81/x",
        "http://net/de/", "x://org/es/", "http://EXAMPLE.org?/es/", "http://é.org/es/ü", "http://h/a://b/c", "http://a.com\n/en/1", "http://" + "a" * 50_000 + ".com/en/",
    ]
    df = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[4]), (None, urls[5])], "page_id long, url string").withColumn("parts", F.lit(1)).withColumn("known", F.lit(2))
    out = url_filter.judge(df, spark.createDataFrame([], "key long, bad int")).select("page_id", "url", "known", "judged.*").collect()
    assert len(out) == len(urls) + 2
    for r in out:
        host, path = parts(r["url"])
        rule, action = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (action or "allow") and r["known"] == 2
    assert url_filter.judge(df.limit(0), spark.createDataFrame([], "key long, bad int")).isEmpty()


def test_url_templates(spark):
    """A host's bad branch is blocked, its good ones merge, and rare segments become one wildcard."""
    data, labels = [], []
    for k in range(1200):
        section = ["news", "blog", "ads"][k % 3]
        data.append((k, f"http://site.test/{section}/{k}"))
        labels.append((k, int(section == "ads" and k % 12 != 2)))
    data += [(5000 + k, f"http://site.test/u{k}/x") for k in range(20)] + [(6000 + k, f"http://other.test/ads/{k}") for k in range(3)]
    out = url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(labels, "key long, bad int"))
    found = {r["page_id"]: r["judged"] for r in out.collect()}
    for k in range(1200):
        assert found[k]["verdict"] == ("block" if k % 3 == 2 else "allow")
    assert {found[k]["template"] for k in range(0, 1200, 3)} == {"/+0/#"} and found[2]["template"] == "/ads/#"
    assert {found[5000 + k]["template"] for k in range(20)} == {"/*/x"} and found[6000]["verdict"] == "allow"


def test_url_templates_of_files_and_deep_paths(spark):
    """Numbers before a file ending carry labels, and branches part at any depth."""
    data, labels = [], []
    for k in range(400):
        data.append((k, f"http://site.test/{'ads' if k % 2 else 'news'}/{k}.html"))
        data.append((1000 + k, f"http://deep.test/a/b/c/d/e/f/{'ads' if k % 2 else 'news'}/{1000 + k}/"))
        labels += [(k, k % 2), (1000 + k, k % 2)]
    data += [(5000, "http://site.test/news"), (5001, "http://site.test/")]
    labels = spark.createDataFrame(labels, "key long, bad int")
    found = {r["page_id"]: r["judged"] for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), labels).collect()}
    assert len(found) == len(data)
    for k in range(400):
        name, verdict = ("ads", "block") if k % 2 else ("news", "allow")
        assert (found[k]["template"], found[k]["verdict"]) == (f"/{name}/#.html", verdict)
        assert (found[1000 + k]["template"], found[1000 + k]["verdict"]) == (f"/a/b/c/d/e/f/{name}/#", verdict)
    alone = url_filter.judge(spark.createDataFrame([r for r in data if not 1000 <= r[0] < 2000], "page_id long, url string"), labels)
    assert all(abs(r["judged"]["purity"] - found[r["page_id"]]["purity"]) < 1e-9 for r in alone.collect() if r["page_id"] < 1000)


def test_url_tree_against_plain(spark):
    rnd = random.Random(12)
    paths = {}
    for _ in range(900):
        host = rnd.choice(["a.com", "a.com", "b.org", ""])
        first = rnd.choice(["news", "about", "ads", "forum", "shop", f"odd{rnd.randrange(60)}", "#", "@"])
        segs = (first, *(rnd.choice(["x", "y", "#", "#.html", "deep", "@"]) for _ in range(rnd.choice([0, 0, 1, 1, 2, 5]))))
        if rnd.random() < 0.05:
            segs = ()
        labelled = 0 if first == "forum" else rnd.randrange(4)
        n, had, bad = paths.get((host, segs), (0, 0, 0))
        paths[host, segs] = (n + rnd.randrange(1, 9), had + labelled, bad + sum(rnd.random() < (0.8 if first == "ads" else 0.1) for _ in range(labelled)))
    want = plain.url_templates(paths)
    seen = spark.createDataFrame([(h, list(s), *c) for (h, s), c in paths.items()], "host string, segs array<string>, n long, labelled long, bad long")
    found = {(r["host"], tuple(r["segs"])): (r["template"], r["purity"]) for r in url_filter.template_tree(seen).collect()}
    assert set(found) == set(want) and any(t.startswith("/+") for t, _ in want.values())
    for key, (template, purity) in want.items():
        assert found[key][0] == template and abs(found[key][1] - purity) < 1e-9, key


def test_url_branches_without_labels_are_not_blocked(spark):
    data = [(f"http://a.com/{part}/{k}", k) for part, lo in (("news", 0), ("about", 1000), ("ads", 2000), ("forum", 3000)) for k in range(lo, lo + 400)]
    labels = [(k, 0) for k in range(0, 1400)] + [(k, int(k % 10 < 7)) for k in range(2000, 2400)]
    urls = spark.createDataFrame(data, "url string, k long")
    got = url_filter.judge(urls, spark.createDataFrame(labels, "key long, bad int"), rules=()).select("url", "judged.verdict").collect()
    assert {r["verdict"] for r in got if "/ads/" in r["url"]} == {"block"} and {r["verdict"] for r in got if "/ads/" not in r["url"]} == {"allow"}
    with pytest.raises(ValueError, match="out_col"):
        url_filter.judge(urls, spark.createDataFrame(labels, "key long, bad int"), out_col="URL")


def test_warc(spark, tmp_path):
    body = "<html>" + "ü\r\n\r\n" * 60
    data = [(k, f"http://a/{k}", body if k % 3 == 0 else f"{body}{k}") for k in range(30)]
    data += [(40, None, None), (41, "u\r\nx", ""), (42, "u", "short"), (43, "u", "short"), (7, "http://a/7", f"{body}7"), (None, "n", body), (44, "v", "x" * 300_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("shelf", F.lit(1))
    path = fresh(spark, "test")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in data})
    records = warc.read_archive(spark, path).collect()
    assert len(records) == len(data)
    first = {}
    for i, _, html in data:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = sorted((i, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode()) >= 100 and i != first[h or ""]) for i, _, h in data if i is not None)
    got = sorted((r["id"], hashlib.sha256(r["payload"]).hexdigest(), b"WARC-Type: revisit" in r["header"]) for r in records if r["id"] is not None)
    assert got == expected and all(r["digest"] == hashlib.sha256(r["payload"]).hexdigest() for r in records)
    assert b"WARC-Type: revisit" in next(r for r in records if r["id"] is None)["header"]
    warc.export_files(spark, path, f"{path}-files")
    blocks = warc.read_files(spark, f"{path}-files").collect()
    assert sorted(r["header"] for r in blocks) == sorted(r["header"] for r in records)
    assert sorted(r["block"] for r in blocks) == sorted(b"" if b"WARC-Type: revisit" in r["header"] else r["payload"] for r in records)
    warc.write_archive(df.limit(0), f"{path}-none")
    assert warc.read_archive(spark, f"{path}-none").isEmpty()


def test_warc_notices_damage(spark):
    path = fresh(spark, "test")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="differs"):
        warc.read_archive(spark, f"{path}-2").collect()


ODD_VECTORS = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [float("inf")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, []), (9006, [1.0])]
VECTORS = "vec_id long, embedding array<float>"


def cloud(seed, count, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, dims))
    for k in range(count // 3):
        base[k] = base[0] + 0.22 * rng.standard_normal(dims)
    for k in range(count // 3, count // 2):
        base[k] = base[rng.integers(count // 2, count)] * rng.uniform(0.5, 3) + 0.25 * rng.standard_normal(dims)
    base[-1] = base[-2]
    return [(k * 3, v.astype(np.float32).tolist()) for k, v in enumerate(base)]


def test_embedding_near_copies(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 50)
    data = cloud(1, 400)
    found = cap_filters.near_copies(spark.createDataFrame(data + ODD_VECTORS, VECTORS).withColumn("node", F.lit(1)))
    v = np.array([x for _, x in data], np.float32).astype(float)
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = plain.components(len(data), lambda a, b: near[a, b], [i for i, _ in data])
    expected = [(i, int(n), c, i == c) for (i, _), n, c in zip(data, near.sum(1), comp)] + [(i, 0, i, True) for i, _ in ODD_VECTORS]
    assert near.sum() > 1000 and rows(found) == sorted(expected, key=str)
    assert cap_filters.near_copies(spark.createDataFrame([], VECTORS)).isEmpty()
    assert rows(cap_filters.near_copies(spark.createDataFrame([(None, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0])], VECTORS))) == [(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, False)]


def test_cap_filters_find_links():
    """Nearly all pairs at the least cosine share a filter, also for many vectors."""
    rng, dims = np.random.default_rng(5), 64
    x = rng.standard_normal((400, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, dims))
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for count in (1000, 1_000_000):
        met = np.zeros(400, bool)
        for k in range(cap_filters.CODES):
            code = cap_filters.ProductCode(dims, count, seed=11 + k)
            a, b = (set(zip(*map(np.ndarray.tolist, code.filters(z)))) for z in (x, y))
            met[[row for row, _ in a & b]] = True
        assert met.mean() > 0.98


def test_product_code_lists_all_filters():
    code = cap_filters.ProductCode(8, 300, seed=2)
    x = np.random.default_rng(1).standard_normal((20, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.turn
    sums = (turned[:, : code.cuts[1]] @ code.codes[0])[:, :, None] + (turned[:, code.cuts[1] :] @ code.codes[1])[:, None, :]
    flat = sums.reshape(20, -1)
    height = np.minimum(code.height, -np.sort(-flat, 1)[:, cap_filters.FILTERS_LEAST - 1])
    row, name = code.filters(x)
    assert set(zip(row.tolist(), name.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(flat >= height[:, None] - 1e-9))))


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(projection_search, "CELL", 40)
    monkeypatch.setattr(projection_search, "CHUNK", 16)
    monkeypatch.setattr(projection_search, "FIRST", 15)
    data = cloud(3, 400)
    df = spark.createDataFrame(data + ODD_VECTORS + [(None, [1.0] * 16), data[7]], VECTORS).withColumn("block", F.lit(1))
    found = {}
    for r in projection_search.nearest(df, df.where("vec_id % 20 = 0"), top=10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.array(x, np.float32).astype(float) for i, x in data}
    hit = total = 0
    assert set(found) == {i for i in v if i % 20 == 0}
    for i, got in found.items():
        got.sort()
        best = sorted((-float((v[i] * x).sum()), j) for j, x in v.items() if j != i)[:10]
        assert [k for k, _, _ in got] == list(range(1, 11)) and all(abs(s - float((v[i] * v[j]).sum())) < 1e-9 for _, j, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hit, total = hit + len({j for _, j in best} & {j for _, j, _ in got}), total + 10
    assert hit / total >= 0.95
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0])], VECTORS)
    assert rows(projection_search.nearest(few, few)) == [(0, 1, 20, 4.0, 1), (20, 1, 0, 4.0, 1)]
    assert projection_search.nearest(few.limit(0), few.limit(0)).isEmpty()


@pytest.mark.parametrize("other", [0.0, 1e-3])
def test_nearest_neighbours_of_repeated_ids(spark, monkeypatch, other):
    """Rows that repeat an id, alike or a little apart, push no neighbour out of one block."""
    monkeypatch.setattr(projection_search, "FIRST", 15)
    data = cloud(4, 200)
    again = [(i, [x * (1 - other) for x in v]) for i, v in data]
    query = spark.createDataFrame(data[:10], VECTORS)
    v = {i: np.array(x, np.float32).astype(float) for i, x in data}
    w = {i: np.array(x, np.float32).astype(float) for i, x in again}
    near = max(v, key=lambda j: float((v[0] * v[j]).sum()) if j else -np.inf)
    df = spark.createDataFrame(data + again + [(near, [x * (1 - other * k) for x in v[near].tolist()]) for k in range(30)], VECTORS)
    found = {}
    for r in projection_search.nearest(df, query, top=10).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = 0
    for i, _ in data[:10]:
        score = {j: max(float((v[i] * v[j]).sum()), float((v[i] * w[j]).sum())) for j in v if j != i}
        best = sorted(score, key=lambda j: (-score[j], j))[:10]
        assert len(found[i]) == 10 and (other or all(abs(s - score[j]) < 1e-9 for j, s in found[i].items()))
        hit += len(set(best) & set(found[i]))
    assert hit >= 95


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_nearest_neighbours_leaves_most_unverified(spark, monkeypatch, shift):
    """On clustered vectors, with or without a common mean, the test stops long before all candidates are scored."""
    monkeypatch.setattr(projection_search, "CELL", 250)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((20, 32))
    x = base[rng.integers(0, 20, 4000)] + 0.25 * rng.standard_normal((4000, 32)) + shift
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], VECTORS)
    v, found, verified = x.astype(np.float32).astype(float), {}, {}
    for r in projection_search.nearest(df, df.where("vec_id % 20 = 0"), top=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        verified[r["query_id"]] = r["verified"]
    hit = 0
    for i in range(0, 4000, 20):
        score = v @ v[i]
        score[i] = -np.inf
        hit += len(found[i] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (200 * 20) >= 0.95 and np.mean(list(verified.values())) < 0.4 * 4000


def test_chi_square():
    rng = np.random.default_rng(0)
    draws = (rng.standard_normal((200_000, 12)) ** 2).sum(1)
    assert abs((draws > projection_search.chi_square_point(0.03, 12)).mean() - 0.03) < 0.003


def test_pipeline_stages(spark):
    rnd = random.Random(5)
    letters = {"en": "abcdefg", "fr": "éhijklm"}
    texts = []
    for k in range(120):
        lang = "en" if k % 3 else "fr"
        texts.append((k, " ".join("".join(rnd.choice(letters[lang]) for _ in range(4)) for _ in range(60)), lang, f"s{k % 4}"))
    copies = [(200 + k, texts[k][1] + " more", texts[k][2], texts[k][3]) for k in range(10)]
    odd = [(300, None, "en", "s1"), (301, "12 34", None, None), (302, "", "fr", "s0"), (texts[5][0], *texts[5][1:])]
    data = [(*r, len(r[1] or "")) for r in texts + copies + odd]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("language", F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)
    kept = materialise(stages["language_id"](spark, docs, ""), "a")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted([r[0] for r in texts + copies] + [texts[5][0]])
    one = materialise(stages["ngram_jaccard_join"](spark, kept, ""), "b")
    groups = plain.jaccard([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in groups}) and one.columns == docs.columns
    mixed = materialise(stages["source_mixing"](spark, one, ""), "c")
    assert mixed.columns == docs.columns and not mixed.isEmpty()
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    whole = dict(one.select("doc_id", "text").collect())
    assert all(whole[r["doc_id"]] == r["text"] for r in mixed.collect())
    packed = stages["bestfit_packing"](spark, mixed, "")
    assert packed.where("piece = 0").count() == mixed.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.isEmpty()


def test_near_copies_of_an_id_with_several_texts(spark):
    """A text goes only where a near copy of it stays; columns that cannot be ordered pass through."""
    text = lambda k: " ".join(f"{'abc'[k]}{i}" for i in range(60))
    data = [(1, text(0)), (5, text(0) + " more"), (5, text(1)), (5, text(1) + " more"), (7, None), (7, ""), (7, text(1) + " too"), (9, text(2)), (9, text(2)), (None, text(0)), (8, text(0))]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.create_map(F.lit("a"), F.col("doc_id")))
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, text(0)), (5, text(1)), (7, None), (9, text(2)), (None, text(0))], key=str) or got == sorted([(1, text(0)), (5, text(1)), (7, ""), (9, text(2)), (None, text(0))], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").isEmpty()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert not out.isEmpty()


def test_own_columns_are_not_overwritten(spark):
    df = spark.createDataFrame([(1, "some text", "s")], "doc_id long, text string, source string")
    model = language_id.train(df.select(F.lit("en").alias("lang"), "text"))
    for taken in (df.withColumn("Language", F.lit(1)), df.withColumn("MIX", F.lit(1))):
        with pytest.raises(ValueError, match="out_col"):
            language_id.identify(taken, model, out_col="language") if "Language" in taken.columns else mixing.mix(taken)


def test_no_shared_folder_is_an_error_off_the_local_master():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="shared folder"):
        workdir(Session())


def test_op4_on_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(jaccard_join.op4(spark, "/root/testdata/sf0.001")) == plain.jaccard(data, 4, 85)
