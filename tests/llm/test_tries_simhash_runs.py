"""Prefix tries, fingerprints under the pigeonhole, and periodic runs against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.llm import conversations, periodic, queries, simhash
from gaugeline.llm.scans import running

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie


def plain_trie(rows):
    """Nodes of rebuilt conversations by walking every prefix."""
    kept = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    turns = defaultdict(list)
    for c, t, r, x in sorted(kept, key=lambda v: (v[0], v[1] is not None, v[1] or 0, v[2], v[3])):
        turns[c].append((r, x))
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    out = {}
    for node, found in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = [c for c in found if len(paths[c]) == len(node)]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        out[found[0], len(node)] = (members[node[:-1]][0] if node else None, len(found), len(children), len(leaves), saved, sha(",".join(map(str, ends))))
    return out


def trie_rows(df):
    rows = df.collect()
    found = {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in rows}
    assert len(found) == len(rows)
    return found


TALK = [
    *[(c, t, "user" if t % 2 == 0 else "bot", f"turn {t}") for c in range(0, 12) for t in range(c % 4 + 3)],
    *[(c, t, "user", f"common {t % 3}") for c in (20, 21, 22, 23, 24, 30) for t in range(14)],
    (40, None, None, None), (40, None, "a", "x"), (40, 1, "a", "y"), (40, 1, "a", "x"), (41, 0, "a", None),
    (None, 0, "user", "nobody's"), (53, 0, "ü", "é" * 90), (54, 0, "ü", "é" * 90 + "z"), (54, 0, "ü", "é" * 90), (7_000_000_001, 0, "user", "turn 0"),
]


def talk(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, fp string").repartition(parts)


def test_trie_against_walking_all_prefixes(spark):
    turns, ids = conversations.rebuilt(talk(spark, TALK))
    assert trie_rows(conversations.prefix_trie(turns, ["own", "rank"], ids)) == plain_trie(TALK)


@pytest.mark.parametrize("rolling", [((1, 2), (1, 2)), ((3, 5), (1, 2))])
def test_colliding_fingerprints_are_split(spark, rolling):
    """Moduli so small that almost every group holds different prefixes."""
    turns, ids = conversations.rebuilt(talk(spark, TALK))
    assert trie_rows(conversations.prefix_trie(turns, ["own", "rank"], ids, rolling)) == plain_trie(TALK)


def test_trie_of_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ID_RUN", 7)
    rows = [(3, t, "user", f"t{t}") for t in range(700)] + [(c, t, "user", f"s{t}") for c in range(100, 340) for t in range(2)]
    assert trie_rows(conversations.prefix_trie(*_as_is(talk(spark, rows, 8)))) == _plain_as_is(rows)


def _as_is(turns):
    known = conversations.numbered(turns)
    return known, ["rank"], known.select("conv_id")


def _plain_as_is(rows):
    """The trie of conversations as they are, by a dictionary of children."""
    paths = defaultdict(list)
    for c, _, r, x in rows:
        paths[c].append((r, x))
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children, below = defaultdict(int), {}
    for node in sorted(members, key=len, reverse=True):
        if node:
            children[node[:-1]] += 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves, saved = below.pop(node, (0, 0))
        leaves, saved = leaves or 1, saved + own
        if node:
            a, b = below.get(node[:-1], (0, 0))
            below[node[:-1]] = (a + leaves, b + saved)
        below[node, "done"] = (leaves, saved)
    return {(m[0], len(n)): (members[n[:-1]][0] if n else None, len(m), children[n], *below[n, "done"], sha(",".join(str(c) for c in m if len(paths[c]) == len(n)))) for n, m in members.items()}


def test_no_conversations(spark):
    for rows in (talk(spark, TALK).limit(0), talk(spark, [(None, 0, "a", "b")], 1)):
        turns, ids = conversations.rebuilt(rows)
        assert conversations.prefix_trie(turns, ["own", "rank"], ids).collect() == []


def test_running_sums_over_one_key_in_many_tasks(spark):
    rows = spark.range(5000).select(F.floor(F.col("id") % 3 / 2).alias("k"), "id", (F.col("id") % 7).alias("v"), F.lit("x").alias("rank_"))
    base, modulus = 31, 101
    found = running(rows, "k", ["id"], ["id"], [None, (base, modulus)], lambda p: [p.column("v").to_numpy(), p.column("v").to_numpy() % modulus], ["id", "v"]).orderBy("k", "id").collect()
    rank, plain, rolled = {0: 0, 1: 0}, {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in found:
        k = r["k"]
        assert (r["before_0"], r["before_1"]) == (plain[k], rolled[k])
        rolled[k] = (rolled[k] + r["v"] * pow(base, rank[k], modulus)) % modulus
        rank[k], plain[k] = rank[k] + 1, plain[k] + r["v"]
        assert (r["rank"], r["sum_0"], r["sum_1"]) == (rank[k], plain[k], rolled[k])
    assert len(found) == 5000


# ---- simhash


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_groups(fps, reach=3):
    """The group of every distinct fingerprint by comparing all of them."""
    every = sorted(set(fps))
    group = {f: f for f in every}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    array = np.array(every, dtype=np.uint64)
    for k, f in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= reach):
            group[root(every[k + 1 + j])] = root(f)
    return {f: root(f) for f in every}


def plain_simhash(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    groups = plain_groups([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            g = groups[f]
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f"{f:016x}", least.get(groups[f])) for d, f in fps), key=repr)


def test_simhash_of_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)  # texts in many parts
    rows = odd_documents.collect()
    found = simhash.near_duplicates(odd_documents)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_simhash([(r["doc_id"], r["text"]) for r in rows])
    assert simhash.near_duplicates(no_documents).collect() == []
    nameless = simhash.near_duplicates(odd_documents.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert {r["component_id"] for r in nameless} == {None} and len(nameless) == len(rows)


def test_simhash_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_pigeonhole_simhash(spark, D).collect()), key=repr) == plain_simhash(rows)


def _near(seed, n, centres, flips):
    r = np.random.default_rng(seed)
    out = r.integers(0, 2**63, centres, dtype=np.uint64)[r.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
    return np.unique(out)


@pytest.mark.parametrize(("n", "centres", "flips"), [(3000, 3000, 0), (3000, 40, 4), (3000, 3, 6), (2000, 500, 2)])
@pytest.mark.parametrize("block", [1 << 17, 97])
def test_links_join_what_all_pairs_join(spark, monkeypatch, n, centres, flips, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = _near(n + centres, n, centres, flips)
    classes = simhash.settle(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), "test-classes")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(classes).collect()]
    assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in found)
    group = {int(f): int(f) for f in fps}

    def root(f):
        while group[f] != f:
            group[f] = group[group[f]]
            f = group[f]
        return f

    for a, b in found:
        group[root(a)] = root(b)
    want = plain_groups(fps.tolist())
    mine = {f: root(f) for f in want}
    assert len(set(mine.values())) == len(set(want.values())) == len({(mine[f], want[f]) for f in want})


@pytest.mark.parametrize("scheme", simhash.schemes())
def test_every_scheme_probes_all_within_reach(scheme):
    """Whatever the thresholds, each pair within reach meets where one of the two is filed."""
    fps = _near(5, 400, 12, 3)
    both = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    cells = simhash.cells_of(both.T @ both, len(fps))
    assert sorted(b for c in cells for b in c) == list(range(64))
    near = np.stack([simhash.distances(np.bincount(simhash.cell_values(fps, c), minlength=1 << 16).astype(float)) for c in cells])
    units, _ = simhash.allocate(fps, cells, near, 10**6, scheme)
    assert (units.sum(axis=1) == 4).all()
    part, value, fp, filed = simhash.probes(fps, cells, scheme, units)
    buckets = defaultdict(lambda: (set(), set()))
    for p, v, f, own in zip(part.tolist(), value.tolist(), fp.tolist(), filed.tolist()):
        buckets[p, v][own].add(f)
    met = {(q, x) for asks, held in buckets.values() if held for q in asks | held for x in held}
    close = [(a, b) for a in fps.tolist() for b in fps.tolist() if a != b and (a ^ b).bit_count() <= 3]
    assert close and all((a, b) in met for a, b in close)


def test_distances_are_counted_exactly():
    histogram = np.bincount(np.random.default_rng(1).integers(0, 300, 900), minlength=1 << 16).astype(float)
    found = simhash.distances(histogram)
    at = np.arange(1 << 16)
    for v in (0, 7, 299, 4096):
        apart = np.bitwise_count(at ^ v)
        assert np.allclose(found[v], [histogram[apart == d].sum() / 900 for d in range(4)])


# ---- periodic runs


def plain_runs(words):
    """Maximal stretches of each period whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(doc_id, text, loops):
    words = WORD.findall(text or "")
    n = len(words)
    if loops and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_odd_documents(spark, odd_documents, no_documents):
    texts = ["a b " * 9, "a a a a a a b a a a a a a", "x " * 5, "x " * 6, "a b c d " * 4, "a b a b a b a c " * 4, " ".join("abc" * 40) + " z " + " ".join("ab" * 9), "\t a\na\x0ba\x0ca\ra a ", "a a b a a b a a b a a b a a a a a a"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").unionByName(more)
    want = sorted((plain_periodic(r["doc_id"], r["text"], False) for r in docs.collect()), key=repr)
    found = periodic.periodic_runs(docs, whole=True)
    assert sorted(map(tuple, found.select(COLUMNS).collect()), key=repr) == want
    for r in found.collect():
        assert r["runs_sha256"] == sha("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"])) and r["collapsed_sha256"] == sha(r["collapsed"])
    assert periodic.periodic_runs(no_documents).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 12)), max_size=4), min_size=1, max_size=5))
def test_runs_of_made_sequences(parts):
    docs = sorted(([w for block, times in doc for w in block * times] for doc in parts), key=len, reverse=True)
    sizes = np.array([len(d) for d in docs])
    w = np.concatenate([np.array([*d, -1 - k]) for k, d in enumerate(docs)])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    want = [(int(begin[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d)]
    assert periodic.runs_of(w, sizes) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_run_costs_no_comparing_at_its_multiples():
    w = np.concatenate([np.zeros(400_000, dtype=np.int64), [-1]])
    assert periodic.runs_of(w, np.array([400_000])) == [(0, 400_000, 1)]


def test_periodic_query_against_plain_python(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows if len(t or "") < 8000]
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, D).collect()}
    assert len(rows) > 150 and any(found[d][1] for d, _ in rows)
    for d, t in rows:
        assert found[d] == plain_periodic(d, t, True)


def test_nothing_is_left_behind(spark):
    """Of each query only its result stays in the shared folder, and no table in the catalog."""
    from gaugeline.sources.shared import shared_dir

    def held():
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return {str(f.getPath().getName()) for f in files.listStatus(path)} if files.exists(path) else set()

    tables = {t.name for t in spark.catalog.listTables()}
    for name, kept in (("op3_suffix_tree_repeats", "repeats-removed"), ("op9_circulant_minhash", "near-duplicates"), ("op11_prefix_trie", "trie"), ("op12_pigeonhole_simhash", "fingerprint-groups"), ("op7_bootstrapped_contexts", "personal-data")):
        before = held()
        queries.QUERIES[name](spark, D).count()
        assert [x.rsplit("-", 1)[0] for x in held() - before] == [kept]
        assert {t.name for t in spark.catalog.listTables()} == tables
