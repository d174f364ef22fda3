"""The methods behind the operators, each against brute force, at sizes that reach every path."""

import collections
import hashlib

import numpy as np
import pytest

from pagemill.llm import bpe, bwt, classifier, html, rules, simhash, substring, warc, windows

RND = np.random.default_rng(3)


def prose(n, vocabulary=40):
    return " ".join(f"w{x}" for x in RND.integers(0, vocabulary, n))


PASSAGE = prose(60, 10**6)
#: One passage in other surroundings each time: its edges are hot.
SPREAD = [f"{prose(30, 10**6)} {PASSAGE} {prose(30, 10**6)}" for _ in range(40)]
TEXTS = [*SPREAD, None, "", SPREAD[0], SPREAD[0] + " more", "z" * 300, "z" * 170, prose(4000, 10**6)] + [prose(50, 3) for _ in range(6)]
DOCS = list(enumerate(TEXTS)) + [(3, SPREAD[3]), (None, SPREAD[5]), (None, SPREAD[6] + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


def removed_words(rows, window=35):
    seqs = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[k : k + window]) for w in seqs for k in range(len(w) - window + 1))
    out = collections.Counter()
    for (i, _), w in zip(rows, seqs):
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    return out


def words_found(log):
    return collections.Counter(tuple(r) for r in log.kept(False).collect())


@pytest.mark.parametrize("hot", [2, 512])
def test_log_on_halves_equals_the_whole(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(windows, "SHARD", 1 << 11)
    log = substring.FingerprintLog(spark, hot=hot, bits=3)
    seen: list = []
    for half in (DOCS[::2], DOCS[1::2]):
        log.append(spark.createDataFrame(half, "doc_id long, text string"))
        seen += half
        assert words_found(log) == removed_words(seen)
    assert words_found(substring.search(docs, hot=hot, bits=2)) == removed_words(DOCS)
    entries = log.compact().collect()
    assert sum(len(r["hashes"]) // 5 for r in entries) == sum(len(r["shards"]) // 8 for r in entries) > 0


@pytest.mark.parametrize("hot", [2, 512])
def test_bytes_with_hot_grams(docs, hot, monkeypatch):
    monkeypatch.setattr(windows, "SHARD", 1 << 11)
    first, key = {}, lambda i: 1 << 62 if i is None else i
    for i, t in sorted(DOCS, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], key(i))
    want = collections.Counter()
    for i, t in DOCS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        want[i, int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    got = bwt.removals(docs, hot=hot, bits=3).select("doc_id", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_hot_windows_are_dealt_out(monkeypatch):
    """The largest range does not grow with the number of surroundings of a passage."""
    largest = []
    for n in (400, 800):
        texts = [f"{prose(8, 10**6)} {PASSAGE} {prose(8, 10**6)} ".encode() for _ in range(n)]
        shards = [(b"".join(texts[k : k + 20]), np.cumsum([len(x) for x in texts[k : k + 20]])) for k in range(0, n, 20)]
        rows, found = collections.defaultdict(list), {}
        for k, (body, ends) in enumerate(shards):
            units = windows.Units(body, ends, True)
            found[k] = (units, windows.runs(units, 35, 12))
            u, prints, counts = windows.marked(*found[k][1][2:])
            for p, s in windows.per_range(windows.ranged(u, 8)):
                rows[p].append((k, windows.trimmed(u[s], 8), prints[s].tobytes(), counts[s].tobytes()))
        answers = collections.defaultdict(lambda: ([], []))
        for p, held in rows.items():
            for _, shard, part, blob in windows.match(lambda s: 0, 64)(p, held):
                answers[shard][0].append(part)
                answers[shard][1].append(blob)
        sizes = collections.Counter()
        for k, (units, r) in found.items():
            c = windows.Contents(units, r, *windows.hits(r[2], 8, *answers[k]), 35, 8)
            for p, a, b in c.ranges():
                sizes[p] += b - a
        largest.append(max(sizes.values()) / n)
    assert largest[1] < 1.5 * largest[0] and largest[1] < 0.5


def test_runs_do_not_depend_on_blocks():
    body = prose(3000).encode() + b" "
    units = windows.Units(body, np.array([len(body) // 2, len(body)]), False)
    whole = windows.runs(units, 50, 24)
    for block in (64, 1000):
        cut = windows.runs(units, 50, 24, block)
        assert cut[1].sum() == whole[1].sum() and set(cut[2].tolist()) == set(whole[2].tolist())
        assert np.array_equal(np.repeat(cut[2], cut[1]), np.repeat(whole[2], whole[1]))


def test_contents_with_one_hash_are_told_apart():
    body = b"".join(RND.permutation(list(b"abcdefgh" * 20)).astype(np.uint8).tobytes() for _ in range(2))
    units = windows.Units(body, np.array([160, 320]), False)
    one = (np.array([0, 160]), np.array([5, 5]), np.array([9, 9], np.uint64), np.array([7, 7], np.uint64))
    c = windows.Contents(units, one, np.array([9], np.uint64), np.zeros(1, bool), 50, 4)
    assert len(c.heads) == 2 and sorted(c.which.tolist()) == [0, 1]


@pytest.mark.parametrize("depth", [1, 7, 10, 49, 50])
def test_merged_transforms_are_in_order(depth):
    body = RND.integers(97, 100, 900).astype(np.uint8).tobytes() + b"abcabcabc" * 40
    spots = RND.permutation(len(body) - 50)
    text = bwt.Text(body)
    parts = [spots[:300], spots[300:310], spots[310:]]
    made = [bwt.Transform(text, x, depth) for x in parts]
    for t, x in zip(made, parts):
        strings = [body[s : s + depth] for s in x[t.order].tolist()]
        assert strings == sorted(strings) and len(t.spots) == len(set(strings)) == t.interval[-1] + 1
    order, common = bwt.merge(text, made, depth)
    found = [body[s : s + depth] for s in np.concatenate([t.spots for t in made])[order].tolist()]
    assert found == sorted(found)
    for a, b, n in zip(found, found[1:], common[1:].tolist()):
        assert n == next((k for k in range(depth) if a[k] != b[k]), depth)
    owners = RND.integers(0, 99, len(spots))
    want: dict = {}
    for s, o in zip(spots.tolist(), owners.tolist()):
        want[body[s : s + depth]] = min(want.get(body[s : s + depth], 99), o)
    assert bwt.least(text, spots, owners, depth, 128).tolist() == [want[body[s : s + depth]] for s in spots.tolist()]


def test_every_text_is_stitched(spark):
    c = bpe.Codec()
    texts = [prose(900), "it's  we'll\n\n  " * 300, "x" * 5000 + " end", "\u3000 \t" * 900, "日本語 текст 1234567 " * 200]
    for t in texts:
        found = list(bpe.pieces(t, c.split))
        assert "".join(t[a:b] for a, b in found) == t
        assert c.encode(t) == c.piece.encode_ordinary(t)
    assert sum(len(list(bpe.pieces(t, c.split))) for t in texts) > len(texts)
    ids = spark.createDataFrame([(1, c.encode(texts[4])), (2, []), (None, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(ids).collect()} == {1: texts[4].encode(), 2: b"", None: b""}


def test_split_tiles_link_exactly(spark):
    x = RND.integers(0, 1 << 12, 3000, dtype=np.uint64) << np.uint64(3)
    values = np.unique(np.concatenate([x, x ^ np.uint64(1 << 20), RND.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, side=64)).collect()}
    root = np.arange(len(values))
    while True:
        was = root.copy()
        for a in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values[a] ^ values) <= 2)
            root[near] = np.minimum(root[near], root[near].min())
        if (was == root).all():
            break
    classes = collections.defaultdict(set)
    for v, r in zip(values.view(np.int64).tolist(), root.tolist()):
        classes[r].add(got.get(v, v))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_fit_lowers_the_ordinal_loss():
    """The thresholds and weights found are no worse than a slow search by numerical gradients of the likelihood."""
    rows = []
    for _ in range(400):
        f = np.unique(RND.integers(0, 12, 4))
        score = f.astype(float).mean() + RND.normal(0, 1)
        rows.append((f.astype(np.int64), int(np.digitize(score, [4, 7]))))

    def loss(w, cuts):
        edge = np.concatenate([[-1e9], cuts, [1e9]])
        up = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        return -np.mean([np.log(max(1e-12, up(edge[y + 1] - s) - up(edge[y] - s))) for f, y in rows for s in [w[f].sum()]])

    model = classifier.fit(rows)
    w, cuts = np.zeros(12), np.array([-1.0, 1.0])
    for _ in range(150):
        grad = np.array([(loss(w + 1e-4 * e, cuts) - loss(w - 1e-4 * e, cuts)) / 2e-4 for e in np.eye(12)])
        gc = np.array([(loss(w, cuts + 1e-4 * e) - loss(w, cuts - 1e-4 * e)) / 2e-4 for e in np.eye(2)])
        w, cuts = w - 2.0 * grad * (model.weights[:12] != 0), np.sort(cuts - 2.0 * gc)  # of the features that were screened in
    assert (model.weights[:12] != 0).sum() > 1 and loss(model.weights[:12], model.cuts) < loss(w, cuts) + 0.02


def test_repeated_ids_count_once(spark):
    d = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    held = []
    was, classifier.fit = classifier.fit, lambda rows, *a: held.append(len(rows)) or was(rows, *a)
    try:
        classifier.train(d, labels)
    finally:
        classifier.fit = was
    assert held == [2]


def nearest(found, first):
    """The second pass, by looking at every pair of blocks."""
    out = []
    for k, b in enumerate(found):
        if first[k]:
            out.append(first[k])
            continue
        near = [(abs(j - k), j) for j, o in enumerate(found) if first[j] and o.section == b.section and not (o.article and o.outside)]
        left, right = ([x for x in near if (x[1] < k) == side] for side in (True, False))
        best = [min(x) for x in (left, right) if x]
        kinds = {first[j] for _, j in best}
        if len(kinds) == 1:
            out.append(kinds.pop())
        elif len(best) == 2 and best[0][0] != best[1][0]:
            out.append(first[min(best)[1]])
        else:
            out.append("good" if b.article else "bad")
    return out


LONG = "It is the text of the page and it goes on for as long as it has to be seen as text by all of us. "


def test_second_pass_by_all_pairs():
    kinds = [f"<p>{LONG}</p>", "<p>Short one.</p>", "<h2>Heading</h2>", "<p><a href=x>a link that is all of it</a></p>", "<div class='ad'>Buy it</div>", "<p>zzzz qqqq xxxx jjjj kkkk zzzz qqqq xxxx jjjj kkkk zzzz qqqq xxxx jjjj kkkk zzzz</p>"]
    for _ in range(60):
        inner = "".join(RND.choice(kinds, 12))
        page = f"<nav>menu</nav><article>{inner}</article>{''.join(RND.choice(kinds, 3))}<footer>f</footer>" if RND.random() < 0.6 else inner
        found = html.labelled(page)
        outside = [b for b in found if not b.outside]
        n, m = map(sum, zip(*(html.stop_share(b) for b in outside))) if outside else (0, 0)
        first = [html.first_pass(b, n >= html.KNOWN * m and n > 0) for b in found]
        assert [b.label for b in found] == nearest(found, first)


PAGES = [
    f'<article class="overflow-hidden"><p>{LONG}</p></article>', f'<article data-author="hidden figures"><p>{LONG}</p></article>', f"<article><p data-x='hidden'>{LONG}</p></article>",
    f'<div id="main-search"><article><p>{LONG}</p></article></div>', "<p>Hello world.</p><p>Second one here.</p>", "<p>这是一个很长的段落,里面有很多内容。" + "很多内容" * 30 + "</p><p>第二段也是中文。</p>",
    "<p>Это длинный абзац статьи на русском языке, в котором много слов и совсем нет ссылок на другие страницы.</p><p>Второй короткий.</p>",
    f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"<article><div class='post-header'><h1>The title</h1></div><p>{LONG}</p></article>",
]


@pytest.mark.parametrize("page", PAGES)
def test_nothing_of_the_article_is_lost(page):
    import re

    assert html.main_text(page).split() == re.sub("<[^>]*>", " ", page).split()


def test_long_pages_and_other_columns(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, "x", 5), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["text"] == " ".join([LONG.strip()] * 20_000) and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == ""
    assert html.extract(df.limit(0)).count() == 0
    back = warc.digests(df).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in back} == {1: len(page), 2: 0}


def test_decision_list_verdicts(spark):
    """Labels of both kinds: kept is what the learned rules say, one by one, and never a base failure."""
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 < 2
        body = " ".join(f"v{x}" for x in RND.integers(0, 10**6, 80))
        rows.append((i, body + (" ##" * 30 if bad else "")))
        labels.append((i, int(not bad), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.decisions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["kept"] == bool(q) for i, q, _ in labels if not got[i]["base_failed"])
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_answers_are_joined_shard_by_shard(spark, monkeypatch):
    """A shard's row has its own answers only, packed; a home's are never one array, which grows with shards times ranges."""
    monkeypatch.setattr(windows, "SHARD", 1 << 8)
    docs = spark.createDataFrame([(k, f"text {k} " * 40) for k in range(60)], "doc_id long, text string").coalesce(1)
    s = windows.Shards(docs, 50, 24, words=False, bits=10)
    owned = {r.shard: r.home for r in s.table.select("home", "shard").collect()}
    assert len(owned) > len(set(owned.values()))  # homes with several shards
    rows = [(h, x, p, bytes([p % 251, x % 251])) for x, h in owned.items() if x % 3 for p in range(200)]
    answers = spark.createDataFrame(rows, windows.ANSWERS)
    joined = s.with_answers(answers, answers.where("part < 7"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    found = {r.shard: (windows.opened(r.answers0), windows.opened(r.answers1)) for r in joined.select("shard", "answers0", "answers1").collect()}
    assert set(found) == set(owned)
    for x, pairs in found.items():
        for (parts, blobs), n in zip(pairs, (200, 7)):
            assert dict(zip(parts, blobs)) == ({p: bytes([p % 251, x % 251]) for p in range(n)} if x % 3 else {})


def test_shingle_sets_stay_in_their_buckets(spark, monkeypatch):
    """With more shuffle partitions than buckets, sets are looked up where they are, not dealt out again."""
    from pagemill.llm import near
    from pagemill.llm.common import bucketed

    rows = [(k, k, [1], np.arange(k % 3, 9, dtype=np.uint32).tobytes()) for k in range(12)]
    one = bucketed(spark.createDataFrame(rows, "digest long, fp long, bands array<long>, shingles binary"), "members", "digest", 4)
    pairs = spark.createDataFrame([(0, 3), (0, 1), (0, 2)], "x long, y long")
    plans = []
    monkeypatch.setattr(near, "saved", lambda df, what: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {(r.a, r.b) for r in near.checked(pairs, one, 4).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {(0, 3), (0, 1)}
    assert "Join" in plans[0] and "hashpartitioning(digest" not in plans[0]
