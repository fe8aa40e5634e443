"""Each corpus operator on a small fixture with nulls, empty and long texts, repeats and clashing columns, against brute force."""

import collections
import hashlib
import html
import re
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markerflow.llm import common, decontaminate, exact_dedup, graph, html_text, licenses, line_dedup, mixing, ngram_join, quality, suffix_dedup, toxicity
from markerflow.llm.queries import ORACLES, QUERIES

from ..compare import duck, plain, same

SMALL = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"{WORDS[i % 24]}{i * 7 % 13}" for i in range(30000))
EXTRA = {"h": "x", "size": 1, "source_size": 2, "node": 3, "batch": 4, "entry": "e", "key": "k", "kept": True, "taken": 5, "n": 6, "row": 7, "first": 8, "head": 9, "root": 1, "id": 2, "leaks": "l", "toxicity": 0.5, "spans": "s", "words": "w", "start": 3}


def sentence(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, 24, n))


def corpus():
    base = sentence(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:40] + sentence(9, 80).split())
    texts = [base, near, far, base.upper(), base, None, "", "   \n\t ", "one two three", "ONE two  three", "one two", LONG, LONG + " end", sentence(2) + "\n" + sentence(3), sentence(3) + "é ü " + sentence(4), "x" * 49, "x" * 50, "x" * 120, "y" * 50 + "z", "Ünïcödé " * 30, "ünïcödé " * 30]
    ids = [*range(10, 10 + len(texts))]
    rows = list(zip(ids, texts)) + [(10, base), (None, base + " more"), (None, None), (3, "x" * 50)]
    sources = ["a", "b", None, "a", "é", "B"]
    return [(i, t, "en", sources[k % 6], k) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return str(d)


def bag(rows):
    return collections.Counter(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_license_scan"}))
def test_query_on_small_tables(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        same(df, ORACLES[name], SMALL)
    else:
        assert df.count() > 0


def test_mixing(docs, empty, folder):
    same(mixing.mix_sources(docs), mixing.ORACLE, folder)
    assert mixing.mix_sources(empty).count() == 0
    got = mixing.mix_sources(docs, ["source"]).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (by.target - by.taken).abs().max() < 4  # less than a word for each row that shares the boundary hash
    assert mixing.mix_sources(docs).toPandas().sort_values(["doc_id", "taken"]).taken.tolist() == got.sort_values(["doc_id", "taken"]).taken.tolist()


def test_water_filling(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 0}
    d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(d).collect()}
    assert got["a"] == 3 and got["c"] == 30 and got["d"] == 0 and abs(got["b"] - (1011 - 33)) < 1e-9


@pytest.mark.parametrize("bucket_bytes", [1, 1 << 20])
def test_exact_dedup(docs, empty, bucket_bytes):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs, bucket_bytes).collect()]
    fold = lambda t: (t or "").encode().lower()
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[fold(t)].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            want.append((i, top, len(ids), i == top and left == 1, hashlib.sha256(t).hexdigest()))
            left -= i == top
    assert bag(got) == bag(want)
    assert exact_dedup.exact_dedup(empty).count() == 0
    carried = exact_dedup.exact_dedup(docs, carry=["text", "size"]).where("kept").collect()
    assert len(carried) == len(groups) and {r.size for r in carried} == {1}


def test_directory_doubles():
    sizes = np.zeros(1 << 20, np.int64)
    sizes[[0, 1, 1 << 19]] = 10
    d = exact_dedup.Directory(sizes, 15)
    assert d.depth == 20 and len(d.slots) == 1 << 20  # two neighbours part at the last bit
    h = np.array([0, 1 << 44, -(1 << 63)], dtype=np.int64)
    assert len(set(d.find(h).tolist())) == 3
    assert exact_dedup.Directory(np.zeros(1 << 20), 1).find(h).tolist() == [0, 0, 0]


BENCH = [(1, "alpha beta"), (2, sentence(3)), (2, sentence(3)), (None, "Kappa, LAMBDA"), (3, None), (4, "..."), (5, sentence(1, 120)), (6, "one two three")]


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, empty, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.find_leaks(docs.drop("leaks"), bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for i, t, *_ in corpus():
        w = words(t)
        at = collections.defaultdict(list)
        for k in range(len(w)):
            for n in range(1, 11):
                at[tuple(w[k : k + n])].append(k) if k + n <= len(w) and n in (2, 3, 10) else None
        hit, items = set(), set()
        for item, text in BENCH:
            b = words(text)
            for k in range(max(1, len(b) - 9) if b else 0):
                win = tuple(b[k : k + 10])
                for p in at.get(win, ()):
                    hit.update(range(p, p + len(win)))
                    items.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert bag(got) == bag(want)
    row = found.where("doc_id = 18").select("text", "leaks.cuts", "leaks.spans").first()
    assert [(c.start, c.end) for c in row.cuts] == [(0, len("one two three"))] and [(s.start, s.end) for s in row.spans] == [(0, 3)]
    assert decontaminate.find_leaks(empty, bench).count() == 0
    none = decontaminate.digest(decontaminate.find_leaks(docs.drop("leaks"), bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(corpus())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=4))
def test_fm_index_finds_what_a_scan_finds(shard, patterns):
    item = lambda x: " ".join(f"w{v}" for v in x).encode()
    p = decontaminate.Phrases([(str(k), item(x)) for k, x in enumerate(patterns)])
    number = {0: 0} | {v: p.number(f"w{v}".encode()) for v in (1, 2, 3)}
    shard = [[number[v] for v in d] for d in shard]
    patterns = [[number[v] for v in x] for x in patterns]
    position, window = decontaminate.search([np.array(d, dtype=np.int64) for d in shard], p)
    got = [(i, int(k)) for i, w in zip(position.tolist(), window.tolist()) for k in (p.names[o] for o in p.owner[p.owned[w] : p.owned[w + 1]])]
    flat = [v for d in shard for v in [*d, 0]]
    assert sorted(got) == sorted((i, k) for k, x in enumerate(patterns) for i in range(len(flat)) if flat[i : i + len(x)] == x)


def test_phrases_are_small_and_right():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(1)
    words = [f"w{i:x}" for i in rng.integers(0, 1 << 40, 200_000)]
    items = [(str(i), " ".join(words[j] for j in rng.integers(0, len(words), 1200)).encode()) for i in range(200)] + [(str(i), " ".join(words[i : i + 3]).encode()) for i in range(20_000)]
    p = decontaminate.Phrases(items)
    data = pickle.dumps(p)
    text = sum(len(t) for _, t in items)
    tracemalloc.start()
    read = pickle.loads(data)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 9 * text  # 16 MB of text: under 150 MB
    for name, t in items[::997]:
        ids = [read.number(w) for w in decontaminate.words_of(t)]
        assert 0 not in ids and len(set(ids)) == len(set(decontaminate.words_of(t)))
        k = int(np.flatnonzero((read.ids[read.start] == ids[0]) & (read.ids[read.start + 1] == ids[1]))[0])
        assert name.encode() in [read.names[o] for o in read.owner[read.owned[k] : read.owned[k + 1]]]
    assert read.number(b"never") == 0


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min(least.get(g, 1 << 63), (1 << 62) if i is None else i)
    return [(i, len(s), i if not s else None if least[g] == 1 << 62 else least[g]) for (i, *_), g, s in zip(rows, group, sets)]


@pytest.mark.parametrize("tile", [1000, 1])
def test_ngram_join(docs, empty, tile):
    got = [tuple(r) for r in ngram_join.ngram_join(docs, tile=tile).collect()]
    assert bag(got) == bag(brute_components(corpus()))
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_a_chain_of_near_copies(spark):
    """Neighbours link, ends do not: components must come from links and not from similarity to one representative."""
    words = sentence(4, 150).split()
    rows = [(100 + k, " ".join([f"new{i}" if i < 3 * k else w for i, w in enumerate(words)])) for k in range(12)] + [(500, sentence(5, 60))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile in (1000, 3):
        assert bag(tuple(r) for r in ngram_join.ngram_join(d, tile=tile).collect()) == bag(brute_components(rows))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=14), min_size=2, max_size=12))
def test_tiles_link_what_pairs_link(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    label = list(range(len(sets)))
    want = list(label)
    for i in range(len(sets)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                want = [want[j] if g == want[i] else g for g in want]
    for i, j in ngram_join.tile_links(arrays, np.zeros(len(sets)), False):
        label = [label[j] if g == label[i] else g for g in label]
    same_group = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j]}
    assert same_group(label) == same_group(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 3), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_suffix(rows):
    first = {}
    rows = [((1 << 63) if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for rank, _, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], rank), rank)
    out = []
    for rank, i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < rank:
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, empty):
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs).drop("spans").collect()]
    assert bag(got) == bag(brute_suffix(corpus()))
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_crossing_passages(spark):
    rng = np.random.default_rng(8)
    piece = lambda n: "".join(rng.choice(list("abcd \n"), n))
    shared = [piece(n) for n in (49, 50, 51, 75, 130)]
    rows = [(int(i), piece(int(rng.integers(0, 60))) + "".join(shared[k] + piece(int(rng.integers(0, 9))) for k in rng.integers(0, 5, 3))) for i in rng.permutation(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert bag(tuple(r) for r in suffix_dedup.suffix_dedup(d).drop("spans").collect()) == bag(brute_suffix(rows))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=4), max_size=12), min_size=0, max_size=6))
def test_loser_tree_merges_with_common_prefixes(runs):
    width = suffix_dedup.WIDTH
    runs = [sorted({x.ljust(width, b"\1") for x in r}) for r in runs]
    rows = [np.frombuffer(b"".join(r), np.uint8).reshape(-1, width) for r in runs]
    coded = [suffix_dedup.decode(suffix_dedup.encode(r), len(r)) for r in rows]
    assert all((a == b).all() for a, (b, _) in zip(rows, coded))
    order, prefix = suffix_dedup.LoserTree([r.tobytes() for r, _ in coded], [s.astype(np.uint8).tobytes() for _, s in coded]).merge()
    at = [0] * len(runs)
    merged = []
    for r in order.tolist():
        merged.append(runs[r][at[r]])
        at[r] += 1
    assert merged == sorted(x for r in runs for x in r)
    for a, b, p in zip(merged, merged[1:], prefix[1:].tolist()):
        assert p == next((k for k in range(width) if a[k] != b[k]), width)


def test_license_scan(spark, docs, empty):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0-line"]
    w = mit.split()
    rows = [(1, sentence(1) + " " + mit.upper() + " " + sentence(2)), (2, sentence(3) + "\n" + apache), (3, " ".join(w[:20] + ["oops"] + w[21:])), (4, " ".join(w[: len(w) // 2])), (5, None), (6, ""), (2, sentence(3) + "\n" + apache), (None, apache), (7, "Licensed under the")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    found = collections.Counter((r.doc_id, r.license) for r in got.collect())
    assert found == {(1, "mit"): 1, (2, "apache-2.0-line"): 2, (3, "mit"): 1, (None, "apache-2.0-line"): 1}
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs).count() == 0
    in_passes = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), pass_bytes=100)
    assert collections.Counter((r.doc_id, r.license) for r in in_passes.collect()) == found
    assert [len(p) for p, _ in licenses.passes({"a": "x" * 60, "b": "y" * 50, "c": "z" * 200}, 120)] == [2, 1] and not licenses.passes({"c": "z" * 200}, 120)[0][1]
    assert licenses.scan_licenses(docs, {}).count() == 0


def test_license_scan_equals_sql(spark):
    same(QUERIES["op1_license_scan"](spark, SMALL), ORACLES["op1_license_scan"], SMALL)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>
<!-- <p>hidden, hidden, hidden --><div class="ad">buy, buy, buy now</div><article><h1>A &amp; B</h1><p><b>One,  two<br>three &#233;.<p>Four <a href=y>link</a> five, six.</p><aside>side</aside><form>f</form>
<div class="comments"><p>nice, very nice, really</p></div></article><footer>&copy; foot</footer>"""


def test_html(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &lt;text&gt;"), (5, "u", "<p>open <b>never closed"), (1, "u", PAGE), (6, "u", "<!-- all"), (7, "u", "<script>x")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(d).collect()}
    assert got == {1: "A & B\nOne, two three é.\nFour link five, six.", 2: "", 3: "", 4: "plain <text>", 5: "open never closed", 6: "", 7: ""}
    assert html_text.extract(d).count() == 8 and html_text.extract(d.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 3000 + "<p>deep, deep text" + "</div>" * 3000) == "deep, deep text"
    other = '<body class="has-sidebar"><header>Site</header><div id=w><div class="sidebar"><p>a, b, c, d, e</p></div><div class=post><h2>T</h2><section><p>First, part, of the text.</p></section><section><p>Second, part.</p></section></div></div>'
    assert html_text.main_text(other) == "T\nFirst, part, of the text.\nSecond, part."


def test_html_of_the_tables(spark):
    for r in html_text.extract(common.table(spark, SMALL, "pages")).collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in want if b)


def test_line_dedup(spark, tmp_path):
    page = lambda i: f"<nav>Menu</nav><p>Body {i}</p><p>Often</p><footer>Foot</footer>" if i % 2 else f"<nav>Menu</nav><p>Body {i}<p>Menu"
    rows = [(i, f"https://h{i % 2}.example.com/{i}", page(i // 2)) for i in range(12)] + [(50, None, "<p>a"), (51, "no url", None), (52, "https://once.example.com", "<p>x<p>x"), (50, None, "<p>a")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    d.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = line_dedup.line_dedup(d)
    same(got, line_dedup.ORACLE, str(tmp_path))
    assert {r.text for r in got.where("page_id = 2").collect()} == {"Body 1"}
    assert line_dedup.line_dedup(d.limit(0)).count() == 0
    assert len(duck(line_dedup.ORACLE, str(tmp_path))) == 16


def auc(y, p):
    rank = pd.Series(p).rank().to_numpy()
    a, b = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - a * (a + 1) / 2) / (a * b)


def labelled_docs(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(700):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = [WORDS[k] for k in rng.integers(0, 24, 60)]
        if toxic:
            for k in rng.integers(0, 60, 3):
                words[k] = ["grumblek", "snarlish", "vexoid"][k % 3]
        text = " ".join(words)
        rows.append((i, "!! ".join(text.upper().split()) if bad else text, "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (5000, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, LONG, "en", "s", 0)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, empty, kind):
    docs, labels = labelled_docs(spark)
    run, column, least = (toxicity.toxicity, "toxicity", toxicity.TOXIC) if kind == "toxic" else (quality.quality, "quality_score", quality.GOOD)
    got = run(docs, labels).select(*toxicity.verdict(column, least)).toPandas()
    assert len(got) == 703 and got.score.between(0, 1).all() and (got.predicted == (got.score >= least)).all()
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out].merge(labels.dropna().toPandas(), on="doc_id")
    assert len(held) > 100 and auc(held[kind].to_numpy(), held.score) > 0.95
    again = run(docs, labels).select(*toxicity.verdict(column, least)).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()
    assert run(empty, labels).count() == 0
    none = run(docs, labels.limit(0)).toPandas()
    assert none[column].nunique() == 1 and 0 <= none[column][0] <= 1
    one = run(docs, labels.where(f"{kind} = 1")).toPandas()
    assert one[column].nunique() == 1


def test_naive_bayes_ratios_and_regression():
    """Against counts and a plain gradient descent, feature by feature."""
    rng = np.random.default_rng(11)
    have = rng.random((60, 9)) < np.linspace(0.1, 0.9, 9)
    y = (have[:, 2] ^ (rng.random(60) < 0.2)).astype(float)
    total = np.bincount(y.astype(int), minlength=2)
    counts = np.stack([have[y == k].sum(axis=0) for k in (0, 1)])
    ratio = toxicity.log_count_ratios(counts, total)
    worth = toxicity.likelihood_ratios(counts.astype(float), total)
    for f in range(9):
        in_one, in_other = sum(have[i, f] for i in range(60) if y[i]), sum(have[i, f] for i in range(60) if not y[i])
        assert abs(ratio[f] - np.log(((in_one + 1) / (total[1] + 2)) / ((in_other + 1) / (total[0] + 2)))) < 1e-12
        g = 0.0
        for k in (0, 1):
            for on in (True, False):
                seen = sum(1 for i in range(60) if y[i] == k and have[i, f] == on)
                expected = total[k] * sum(1 for i in range(60) if have[i, f] == on) / 60
                g += 2 * seen * np.log(seen / expected) if seen else 0.0
        assert abs(worth[f] - g) < 1e-9
    entries = [np.flatnonzero(h) for h in have]
    blocks = [(np.repeat(np.arange(i, min(i + 7, 60)), [len(e) for e in entries[i : i + 7]]), np.concatenate(entries[i : i + 7])) for i in range(0, 60, 7)]
    v, b = toxicity.regression(blocks, y, ratio, 4000, 1e-2)
    x = have * ratio
    slope = x.T @ (1 / (1 + np.exp(-(x @ v + b))) - y) + 1e-2 * 60 * v
    assert np.abs(slope).max() < 1e-5 and abs((1 / (1 + np.exp(-(x @ v + b))) - y).mean()) < 1e-6  # the gradient of the loss is 0 there


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 12, (300, 3)).astype(float), (rng.random(300) < 0.4).astype(float)
    y[x[:, 1] > 6] = 1
    model = quality.fit(x, y)
    base = np.log((y.sum() + 0.5) / (300 - y.sum() + 0.5))
    p = 1 / (1 + np.exp(-base))
    g, h = p - y, np.full(300, p * (1 - p) + 1e-6)
    best = max(
        (gl := g[left].sum()) ** 2 / (h[left].sum() + 1) + (g.sum() - gl) ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        for f in range(3)
        for t in np.unique(x[:, f])
        if min((left := x[:, f] <= t).sum(), (~left).sum()) >= quality.LEAF
    )
    left = x[:, model["feature"][0, 0]] <= model["threshold"][0, 0]
    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    assert abs(gain - best) < 1e-9 and model["feature"][0, 0] == 1


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_with_repeats_nulls_and_clashing_columns(spark, kind):
    from pyspark.sql import functions as F

    docs, labels = labelled_docs(spark)
    few = toxicity.labelled(docs, labels, kind, 50)
    assert few.count() == 50
    many = docs.union(docs).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    assert toxicity.labelled(many, labels, kind, 50).count() == 50  # repeated ids add no rows
    wide = many.withColumns({n: F.lit("own") for n in ("y", "id", "x", "toxic", "quality")})
    run, column = (toxicity.toxicity, "toxicity") if kind == "toxic" else (quality.quality, "quality_score")
    got = run(wide, labels, train_rows=300)
    assert got.count() == 2 * 703 + 3 and {tuple(r) for r in got.select("y", "id", "x", "toxic", "quality").distinct().collect()} == {("own",) * 5}
    assert got.where("doc_id IS NULL AND toxicity IS NULL" if kind == "toxic" else "doc_id IS NULL AND quality_score IS NULL").count() == 0
    by_text = got.groupBy("text").agg(F.count_distinct(column).alias("n")).where("n > 1")
    assert by_text.count() == 0


def test_largest_and_smallest_ids(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, "x" * 60), (low, "x" * 60), (None, "X" * 60), (top, "lone text"), (None, None), (low, "lone text more")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect()}
    assert got == {(top, top, 3, True), (low, top, 3, False), (None, top, 3, False), (top, top, 1, True), (None, None, 1, True), (low, low, 1, True)}
    joined = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(d).collect()}
    assert joined == {(top, low), (low, low), (None, low), (top, top), (None, None)}
    cut = {(r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect()}
    assert (top, 60) in cut and (low, 0) in cut and (None, 0) in cut


def test_hot_anchors_are_spread_and_lose_nothing(spark, monkeypatch):
    """One 24-byte string in very many contexts, some of which repeat."""
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    rng = np.random.default_rng(13)
    anchor = "the same words in all of "
    rows = [(i, "".join(chr(97 + c) for c in rng.integers(0, 2, 30)) + anchor + "".join(chr(97 + c) for c in rng.integers(0, 2, 30))) for i in range(40)]
    rows += [(100 + i, t[5:] + "tail") for i, t in rows[:10]]
    at, keys = suffix_dedup.anchors(rows[0][1].encode())
    context = suffix_dedup.contexts(rows[0][1].encode(), at)
    wide = suffix_dedup.spread(context, keys, at, np.ones(len(at), bool))
    assert len(wide[0]) == 2 * len(at) and len(set(wide[1].tolist())) == 2 * len(at)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bag(tuple(r) for r in suffix_dedup.suffix_dedup(d).drop("spans").collect()) == bag(brute_suffix(rows))


def test_labels_of_a_block_are_cells_of_their_own(spark):
    """A group of near copies beside texts that share its words and do not link: every pair of labels meets, no pair within one does."""
    words = sentence(21, 80).split()
    rows = [(i, " ".join(words[:40] + [f"n{i}"] + words[40:])) for i in range(12)]
    rows += [(50 + i, " ".join(words[: 55 + i] + sentence(60 + i, 25).split())) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tile in (1000, 4, 1):
        assert bag(tuple(r) for r in ngram_join.ngram_join(d, tile=tile).collect()) == bag(brute_components(rows))
    texts = spark.createDataFrame([(1, 7 if i < 10 else 100 + i, i, b"", 50, 10) for i in range(14)], "root long, label long, node long, text binary, n long, size long")
    met = ngram_join.tiled(texts, 4, 1 << 20).collect()
    sides = [(a, b) for a in met for b in met if (a.low, a.high) == (b.low, b.high) and a.node < b.node and (a.cell != b.cell or a.low == a.high)]
    assert {(a.node, b.node) for a, b in sides if a.label != b.label} == {(i, j) for i in range(14) for j in range(i + 1, 14) if j >= 10}
    assert not [1 for a, b in sides if a.label == b.label]


CLASSES = "comments-area comment-list sidebar-left ad-slot ad-container cookie-bar related-posts share-buttons footer-links nav-item newsletter-box promo-box notice-bar".split()


def test_html_names_and_siblings(spark):
    long = "A sentence of the article, with commas, and some more words. " * 4
    for name in CLASSES:
        for page in ('<body><div class=post><h1>T</h1><p>{0}</p><div class="{1}"><p>Junk, junk.</p></div></div>', '<body><article><p>{0}</p><div id="{1}"><p>Junk, junk.</p></div></article>', '<body><div><p>{0}</p></div><div class="{1}"><p>Junk, junk.</p></div>'):
            text = html_text.main_text(page.format(long, name))
            assert "Junk" not in text and long.strip() in text, name
    assert html_text.main_text(f'<body class="has-sidebar comments-open"><div class=post><p>{long}</p></div>') == long.strip()
    board = html_text.main_text(f'<div class="notice-board"><h2>Board</h2><p>{long}</p><p>{long}</p></div><div class=notice><p>Closed today.</p></div>')
    assert board.startswith("Board\n") and "Closed" not in board
    assert html_text.main_text(f"<div class=post><p>Short, yes.</p></div><div id=comments><p>{long}</p></div>") == "Short, yes."
    assert html_text.main_text(f"<div class=post><p>{long}</p></div><div><span>Short closing para of the article.</span></div>").endswith("\nShort closing para of the article.")
    assert html_text.main_text(f"<article><p>{long}</p></article><h2>Related posts</h2><p>Copyright 2020 Somebody</p>") == long.strip()
    d = spark.createDataFrame([(1, "u", f"<p>{long}", "own", "mine")], "page_id long, url string, html string, text string, n_chars string")
    row = html_text.extract(d).first()
    assert row.text == long.strip() and row.n_chars == "mine"


@pytest.mark.parametrize("page", ["<a " * 350000, "<div>" * 100000 + "<p>x", '<a "' * 200001 + ">", "<i>" * 100000 + "</b>" * 100000, "<b>" * 60000 + "<hr>" * 60000, "<p " + "a" * 1000000 + ">x", "<" * 500000, "<!--" * 200000, "<script>" * 100000, "<div class=sidebar>" * 50000], ids=range(10))
def test_html_is_linear(page):
    import time

    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8


ODD_HTML = [
    "<p>a<!-- b --><p>c<!-- d <!-- e --> f<!-- never <p>closes", "<!--><p>x--><p>y", "--><p>z", "<script>if (a<b) {}</script >t<script>u<script>v</SCRIPT>w<style>x", "<scripted>kept</scripted>",
    "1 < 2 <p>3 > 4 <div <p>5", "<p title='a>b'>q<<<<b>r", "<a\nb>c<", "<!-- only", "<p>é<!--ü-->ö\t\r x", "<div", ">", "<>", "",
]


def test_lines_of_malformed_pages(spark, tmp_path):
    rows = [(i, f"https://m.example.com/{i}", h) for i, h in enumerate(ODD_HTML)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    d.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    same(line_dedup.line_dedup(d), line_dedup.ORACLE, str(tmp_path))
    got = {r.page_id: r.text for r in line_dedup.line_dedup(d).collect()}
    assert got[0] == "a\nc f" and got[8] == "" and got[10] == "<div" and got[3].split("\n")[0] == "t"


@pytest.mark.parametrize("opening", ["<!-- ", "<script ", "<style>", "<div ", "<", "<p ", "</script   "])
def test_a_long_malformed_page_is_linear(spark, opening):
    d = spark.createDataFrame([(1, "https://m.example.com", "<p>text</p>" + opening * ((1 << 20) // len(opening)))], "page_id long, url string, html string")
    line_dedup.line_dedup(d.limit(1)).count()
    start = time.perf_counter()
    assert line_dedup.line_dedup(d).first().text.startswith("text")
    assert time.perf_counter() - start < 6  # of which most is jobs


def test_line_dedup_of_large_hosts(spark, tmp_path):
    rows = [(i, f"https://h{i % 2 if i % 5 else 0}.example.com/{i}", f"<p>Menu {i % 2 if i % 5 else 0}<p>Body {i}<p>Foot", "own") for i in range(60)] + [(60, None, None, "own")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    d.drop("host").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for bytes_, pages in ((1 << 20, 10_000), (0, 10), (0, 1000)):
        same(line_dedup.line_dedup(d, list_bytes=bytes_, share_pages=pages), line_dedup.ORACLE, str(tmp_path))


def test_trees_flattened_walk_equals_recursion():
    rng = np.random.default_rng(4)
    x = rng.random((500, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.Trees(0)
    vars(trees).update(quality.fit(x, y))
    margin = trees.margin(x)
    for i in range(0, 500, 50):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[i, f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(total - margin[i]) < 1e-9
    assert ((margin > 0) == (y == 1)).mean() > 0.97


def test_removing_the_subpackage_leaves_the_rest(tmp_path):
    """As in a checkout from which both folders and the pipeline are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    rest = tmp_path / "rest"
    shutil.copytree(root, rest, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    assert not list(rest.rglob("llm")) and not (rest / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), sorted(n for n in names if n == 'pipeline' or n.startswith('op')))"
    out = subprocess.run([sys.executable, "-c", code], cwd=rest, env={**os.environ, "PYTHONPATH": str(rest)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, left = out.stdout.split(" ", 1)
    assert int(count) > 150 and left.strip() == "[]"
    with_both = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=rest, env={**os.environ, "PYTHONPATH": str(rest)}, capture_output=True, text=True, timeout=120)
    assert with_both.returncode == 0, with_both.stdout[-2000:]



PROSE = "The river rises in the hills, runs past the old mill, and reaches the sea after forty miles. It floods in spring, when the snow melts."
ARTICLE = "".join(f"<p>{PROSE} Part {i}.</p>" for i in range(6))


def paragraphs(n=6):
    return "\n".join(f"{PROSE} Part {i}." for i in range(n))


@pytest.mark.parametrize("page,want", [
    (f"<body><form id=aspnet>{ARTICLE}<label>Search</label><input name=q><button>Go</button></form></body>", paragraphs()),
    (f"<body><form action=/ id=f><div><h1>Title here</h1>{ARTICLE}</div><fieldset><legend>Login</legend><label>User <input></label></fieldset></form></body>", "Title here\n" + paragraphs()),
    (f"<body>{ARTICLE}<form>Search the site <input></form></body>", paragraphs()),
    (f"<body>{ARTICLE}<form><p><label>Your name</label><input></p><p>Your address will not be published.</p><textarea>x</textarea></form></body>", paragraphs()),
    ("<body><p>Hi there, all.</p><form>Search this whole site now <input></form></body>", "Hi there, all."),
    (f"<article>{ARTICLE}<div class=zone7><a href=1>You will not believe this</a><a href=2>Ten things to buy</a></div></article>", paragraphs()),
    (f"<article>{ARTICLE}<div class='reader-responses'><div class=r><span class=who>Ann</span><p>Nice.</p></div><div class=r><span class=who>Bob</span><p>I did not like it at all, sorry.</p></div></div></article>", paragraphs()),
    (f"<article><div class=adbox>Great deals on boats</div>{ARTICLE}<div class=adbox>Great deals on mills</div></article>", "Great deals on boats\n" + paragraphs()),
    (f"<article>{ARTICLE}<div class=step><h3>One</h3><p>Boil the water.</p></div><div class=step><h3>Two</h3><p>Add the tea.</p></div></article>", paragraphs() + "\nOne\nBoil the water.\nTwo\nAdd the tea."),
    (f"<article>{ARTICLE}<ul><li>First point of the list</li><li>Second point</li></ul></article>", paragraphs() + "\nFirst point of the list\nSecond point"),
])
def test_page_wide_forms_and_unnamed_junk(page, want):
    assert html_text.main_text(page) == want


def hot_corpus():
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    rows = []
    for i in range(90):  # near copies of one text, all different
        words = list(base)
        words[int(rng.integers(60))] = f"own{i}"
        words += [f"end{j}" for j in range(int(rng.integers(3)))]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{x}" for x in rng.integers(0, 3000, 40))) for i in range(60)] + [(200, rows[0][1]), (201, rows[0][1].upper()), (202, None)]
    return rows


@pytest.mark.parametrize("many", [3, 20, 255])
def test_ngram_join_with_a_hot_group(spark, many):
    rows = hot_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    linked = [[bool(a and b and 100 * len(a & b) >= 75 * len(a | b)) for b in sets] for a in sets]
    least = [i for i, _ in rows]
    while True:
        new = [min([least[a]] + [least[b] for b in range(len(rows)) if linked[a][b]]) for a in range(len(rows))]
        if new == least:
            break
        least = new
    want = [(rows[k][0], len(sets[k]), least[k]) for k in range(len(rows))]
    got = ngram_join.ngram_join(df, tile=10, many=many)
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == bag(want)
    if many == 20:
        full = ngram_join.ngram_join(df, tile=10, many=many, every=True)
        different = [len({frozenset(sets[b]) for b in range(len(rows)) if linked[a][b] and (rows[b][1] or "").lower() != (rows[a][1] or "").lower()}) for a in range(len(rows))]
        assert bag((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in full.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == bag((*w, n) for w, n in zip(want, different))


def test_a_hot_shingle_is_dealt_over_many_tasks(spark):
    """Postings of near copies, which all have the same shingles, by part."""
    from markerflow.llm import batches

    texts = [ngram_join.words_joined(t.encode()) for _, t in hot_corpus()[:90]]
    own = [ngram_join.shingles(t) for t in texts]
    keys, counts = np.unique(ngram_join.short(np.concatenate(own)), return_counts=True)
    flags = [{"part": 0, "flags": __import__("zstandard").ZstdCompressor().compress(np.minimum(counts, 255).astype(np.uint8).tobytes())}]
    pdf = pd.DataFrame([{"nodes": list(range(90)), "packed": batches.pack(texts), "flags": flags}])
    rows = pd.concat(ngram_join._rare(8, 20)(iter([pdf])))
    size = {p: sum(len(batches.unfront(__import__("zstandard").ZstdDecompressor().decompress(r))) for r in g["run"]) for p, g in rows.groupby("part")}
    lanes = [n for p, n in size.items() if p >= 8]
    assert len(lanes) == 8 and max(lanes) < 2.5 * np.median(lanes) and sum(lanes) > 0.5 * sum(size.values())
