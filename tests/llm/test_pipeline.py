"""The pipeline, stage by stage, against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_training_data import BYTES, PLAIN, ids_of, spans

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    vocabulary = [f"word{k}" for k in range(600)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(vocabulary, rng.integers(20, 200)))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 10 == 1:
            text += " mail me: someone.1@mail.example.com or +1 (555) 555-0100 now"
        if i % 12 == 5:
            text = rows[-2][1] if i % 8 else rows[-2][1] + " more"
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    rows.append((240, None, "en", "a", 0))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0 or "!!" not in rows[i][1]), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) == i for i in range(len(texts))]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [sorted(map(tuple, docs.collect()))]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
        if k + 1 < len(pipeline.STAGES):
            assert docs.columns == columns
            seen[-1] = sorted(map(tuple, seen[-1]))
    start, sound, single, clean, mixed, packed = seen
    poor = {r[0] for r in start if "!!" in (r[1] or "")}
    kept = {r[0] for r in sound}
    assert not kept & poor and {r[0] for r in start if r[1]} - poor <= kept and set(sound) <= set(start)
    assert single == [r for r, keep in zip(sound, links([r[1] for r in sound])) if keep]
    for before, after in zip(single, clean):
        text = before[1]
        if text is not None:
            for kind, a, b in reversed([s.split(":") for s in spans(text).split(",") if s]):
                text = f"{text[: int(a)]}<{kind}>{text[int(b):]}"
        assert after == (before[0], text, *before[2:4], len(text) if text is not None and text != before[1] else before[4])
    assert any("<phone>" in (r[1] or "") for r in clean) and not any(re.search(PLAIN[0], r[1] or "") for r in clean)
    size = {r[0]: len((r[1] or "").split()) for r in clean}
    times = Counter(r[0] for r in mixed)
    assert set(mixed) <= set(clean) and max(times.values()) <= 2
    total, taken, weight = Counter(), Counter(), dict(zip(["a", "b", None], [3, 1, 2]))
    for r in clean:
        total[r[3]] += size[r[0]]
        taken[r[3]] += size[r[0]] * times[r[0]]
    left, open_, target = 1.5 * sum(total.values()), dict(weight), {}
    while over := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * total[s]]:
        share = {s: left * open_[s] / sum(open_.values()) for s in open_}
        for s in over:
            target[s] = 2 * total[s]
        left -= sum(target[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
        assert share
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in total)
    text_of, got = {r[0]: r[1] or "" for r in clean}, Counter()
    for r in packed:
        ids = ids_of(BYTES, text_of[r["doc_id"]], 0)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        got[r["doc_id"]] += r["length"]
    assert got == Counter({d: n * len(ids_of(BYTES, text_of[d], 0)) for d, n in times.items()})
    pieces = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert pieces(pipeline.run(spark, folder).collect()) == pieces(packed)
