"""Each operator on odd documents, on an empty table, and against brute force."""

import hashlib
import io
import itertools
import math
import re
import time
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeline.llm import components, frames, media, minhash, mixing, packing, private, quality, shingles, substrings, tokens, toxicity, weighted
from gaugeline.llm.queries import tokenizer_file

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return np.array(t.encode(text, add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_same_ids(made_documents, path):
    texts = [t for _, t in made_documents] + ["a  b", " a", "b ", "a\n b,c. d", "Hi, there.\nOk", "é b́ c", "Σας ΑΣ b", "don't 's a.b! c??", "́a b"]
    texts += ["hello <|endoftext|> world", "a<|endoftext|>", "<|endoftext|><|startoftext|>", "say <|startoftext|> <|ENDOFTEXT|> x", "<|endoftext |> < |endoftext|>", "<|endof", "text|>"]
    from tokenizers import Tokenizer

    added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    texts += [form for t in added for form in (t, f"x {t} y", f"x{t.upper()}y", t + t)]
    assert added
    for t, got in zip(texts, tokens.encoder(path).ids(pa.array(texts))):
        assert got.tolist() == ids_of(path, t, 0)[:-1].tolist(), t[:50]


def test_packing(odd_documents, no_documents, made_documents):
    rows = packing.pack(odd_documents, BYTES).collect()
    assert packing.pack(no_documents, BYTES).count() == 0
    pieces = Counter()
    for r in rows:
        ids = ids_of(BYTES, dict(made_documents)[r["doc_id"]], 0)
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]] += r["length"]
    n = Counter(d for d, _ in made_documents)
    assert pieces == Counter({d: n[d] * len(ids_of(BYTES, t, 0)) for d, t in made_documents})
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert sum(sum(n for _, n in p) < 1024 for p in by_sequence.values()) <= 1  # one a packer


def test_level_array_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    levels = packing.LevelArray(64)
    for size in rng.integers(1, 64, 400):
        sums = {}
        for h in range(64 - size + 1):
            if h and not levels.counts[h]:
                continue
            after = levels.counts.copy()
            if h:
                after[h] -= 1
            if h + size < 64:
                after[h + size] += 1
            sums[h] = int((after[1:] ** 2).sum())
        assert sums[levels.best_level(size)] == min(sums.values())
        levels.place(("d", 0, np.zeros(size), size), int(size))


def test_frames(spark, odd_documents, no_documents, made_documents, tmp_path):
    manifest = frames.write_frames(odd_documents, WORDS, 2, shards=3, folder=f"file://{tmp_path}/f")
    rows = frames.read_frames(manifest).orderBy("start").collect()
    want, at = [], 0
    for d, t in made_documents:
        ids = ids_of(WORDS, t, 2)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    path = manifest.orderBy("shard").first()["path"]
    reader = frames.FrameReader(path)
    assert reader.find(3)[0].tolist() == ids_of(WORDS, "a", 2).tolist() and reader.find(999) == []
    import zstandard

    raw = open(path.removeprefix("file://"), "rb").read()
    plain = b"".join(reader.ids(k).tobytes() for k in range(len(reader.docs)))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as r:
        assert r.read(len(plain)) == plain  # any zstandard reader takes the frames
    broken = bytearray(raw)
    broken[int(reader.entries["packed"][0]) - 2] ^= 1
    (tmp_path / "bad").write_bytes(broken)
    with pytest.raises(Exception):  # noqa: B017  by the stream's own check or ours
        assert frames.FrameReader(f"file://{tmp_path}/bad").ids(0).tolist() == reader.ids(0).tolist()
    assert frames.read_frames(frames.write_frames(no_documents, WORDS, 2)).count() == 0


def repeats(texts, w=35):
    words = [[x.decode() for x in t.encode().split()] for t in texts]
    count = Counter(tuple(x[k : k + w]) for x in words for k in range(len(x) - w + 1))
    for x in words:
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if count[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        yield len(x), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(x, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("group", [2, 512])
def test_repeats(spark, odd_documents, no_documents, made_documents, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    got = sorted(tuple(r) for r in substrings.remove_repeats(odd_documents).collect())
    assert got == sorted((d, *x) for (d, _), x in zip(made_documents, repeats([t for _, t in made_documents])))
    if group == 2:
        assert substrings.remove_repeats(no_documents).count() == 0


def test_rows_of_one_id_or_none_keep_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    texts = [(None, a), (None, b), (5, a + " tail"), (7, c), (1, a), (1, b + " end"), (1, " ".join(f"d{k}" for k in range(50))), (None, None), (None, c + " more")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in substrings.remove_repeats(df).collect())
    assert got == Counter((d, *x) for (d, _), x in zip(texts, repeats([t or "" for _, t in texts])))


@pytest.mark.parametrize("group", [1, 3, 9, 512])
def test_repeats_of_random_texts(spark, monkeypatch, group):
    """Small groups send prefixes through all their lengths."""
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = np.random.default_rng(group)
    passages = [" ".join(f"{x}" for x in rng.integers(0, 50, rng.integers(20, 80))) for _ in range(12)]
    # beginnings in common, so that longer prefixes part what shorter ones do not
    passages += [" ".join(passages[0].split()[:20] + [f"{x}" for x in rng.integers(0, 50, 30)]) for _ in range(12)]
    texts = [" ".join([passages[rng.integers(24)], *(f"u{i}_{k}" for k in range(rng.integers(0, 30))), passages[rng.integers(24)]]) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [tuple(r)[1:] for r in substrings.remove_repeats(df).orderBy("doc_id").collect()]
    assert got == list(repeats(texts))


def test_media(odd_documents, no_documents, made_documents):
    rows = {r["doc_id"]: r for r in media.fingerprint(media.to_wav(odd_documents)).collect()}
    assert media.fingerprint(media.to_wav(no_documents)).count() == 0
    for d, t in made_documents:
        raw = t.encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        stored = media.wav_bytes(data)
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == data and w.getsampwidth() == 1
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[5]["codes"] == rows[6]["codes"] and len(rows[12]["codes"]) > 50


def test_short_recordings_and_ends_have_features():
    feature = lambda t: tuple(x.tobytes() for x in media.peak_pairs(*media.band_peaks(media.payload(t))))
    words = "stone river harbour winter letter garden window silver morning distance".split()
    short = [*words, *(" ".join(words[:k]) for k in range(2, 11)), " ".join(words * 3), " ".join(words * 6)]
    prints = [feature(t) for t in short]
    assert all(codes for codes, _ in prints) and len(set(prints)) == len(short)
    for repeats in (4, 5, 9, 40):
        for cut in range(0, 128, 16):
            text = " ".join(words * repeats)[cut:]
            assert feature(text) != feature(text[:-16] + "QJXZ 0123 JQXZ 9")
    assert media.band_peaks(bytes([128]) * 640)[0].size == 0 and feature(None) == feature("")
    # one transform for all sizes: what two texts share has equal codes at equal times
    for size in (200, 830, 900, 2000):
        longer = "".join(chr(97 + x) for x in np.random.default_rng(size).integers(0, 26, size + 130))
        codes = [set(zip(*(x.tolist() for x in media.peak_pairs(*media.band_peaks(media.payload(t)))))) for t in (longer, longer[:size])]
        inside = {(c, t) for c, t in codes[1] if t + (c & 31) < size // media.HOP - media.NEAR - 2}
        assert inside <= codes[0] and len(codes[1]) < size


def test_peaks_of_a_tone_and_shifted_pairs():
    t = np.arange(6000)
    rng = np.random.default_rng(2)
    sound = np.clip(128 + 40 * np.sin(2 * np.pi * t * 32 / 256) * (t // 700 % 2) + 40 * np.sin(2 * np.pi * t * 100 / 256) * (t // 500 % 2) + rng.normal(0, 1, 6000), 0, 255).astype(np.uint8)
    times, bins = media.band_peaks(sound.tobytes())
    assert {32, 100} <= set(bins.tolist())
    late = np.concatenate([np.full(20 * media.HOP, 128, np.uint8), sound])
    a, b = (Counter(zip(*(x.tolist() for x in media.peak_pairs(*media.band_peaks(s.tobytes()))))) for s in (sound, late))
    assert sum((Counter({(c, k + 20): n for (c, k), n in a.items()}) & b).values()) > 0.6 * sum(a.values())


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_weighted_sampling_is_unbiased(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, 60) % 40) for _ in range(40)] + ["one", "one one one one", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = list(itertools.combinations(range(len(texts)), 2))
    for samples, draws in ((weighted.SAMPLES, 1), (64, 12)):
        codes = []
        for draw in range(draws):
            salted = df.withColumn("text", F.regexp_replace("text", r"(\S+)", f"$1_{draw}"))
            got = weighted.fingerprints(salted, F.col("text"), "doc_id", samples=samples).collect()
            codes.append({r["doc_id"]: [r["fingerprint"][8 * k : 8 * k + 8] for k in range(samples)] for r in got})
        code = {d: sum((c[d] for c in codes), []) for d in codes[0]}
        off = np.array([np.mean([x == y for x, y in zip(code[i], code[j])]) - jaccard(texts[i], texts[j]) for i, j in pairs])
        n = samples * draws
        # pairs share words and so their luck: a standard error of all is 0.5 / sqrt(n) at most
        assert abs(off.mean()) < 1 / n**0.5 and np.sqrt((off**2).mean()) < 1 / n**0.5 and np.abs(off).max() < 2.5 / n**0.5


def test_samples_follow_their_definition(spark):
    """Against consistent weighted sampling in plain Python, from the same hashes."""
    words, counts, samples = ["a", "b", "cd", "é"], [1, 2, 70, 1], 24
    df = spark.createDataFrame(list(zip(words, counts)), "word string, n int").select("n", F.xxhash64("word").alias("term"))
    hashes = [F.struct(F.xxhash64("term", F.lit(k)).alias("one"), F.xxhash64("term", F.lit(k + 1_000_000)).alias("two"), weighted.sample(F.col("term"), F.col("n"), k).alias("got")).alias(f"_{k}") for k in range(samples)]
    rows = df.select("n", *hashes).collect()
    seen = Counter()
    for k in range(samples):
        near = []
        for row in rows:
            bits, more, got = row[f"_{k}"]["one"] % 2**64, row[f"_{k}"]["two"] % 2**64, row[f"_{k}"]["got"]
            x, y, z = -math.log1p(-((bits >> 1) + 0.5) / 2**63), -math.log(((more >> 32) + 0.5) / 2**32), -math.log(((more & 0xFFFFFFFF) + 0.5) / 2**32)
            c, s = x + y, math.log((x + y) / x)
            r = s + z
            b = z / r
            t = math.floor(math.log(row["n"]) / r + b)
            near.append(1 - math.exp(-math.exp(math.log(c) - r * (t - b + 1))))
            assert got / 2**63 == pytest.approx(near[-1], rel=1e-6) and (t > 0 or got == bits >> 1)
            seen[t] += 1
        assert min(range(4), key=lambda i: near[i]) == min(range(4), key=lambda i: rows[i][f"_{k}"]["got"])
    assert seen[0] and seen[1] and len(seen) > 2


def test_next_and_edited(odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(weighted, "RANGE_ROWS", 4)
    rows = weighted.compare_with_next(odd_documents).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in odd_documents.orderBy(F.desc("doc_id")).collect()]
    want = Counter()
    for k, (d, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    prints = {}
    for r in rows:
        text = dict(docs)[r["doc_id"]]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert weighted.compare_with_next(no_documents).count() == 0


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def spans(t):
    def fits(k, m):
        d = re.sub("[^0-9]", "", m)
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) if d else 1
        return [True, k == 1 and all(int(x) <= 255 for x in m.split(".")), 12 <= len(d) <= 19 and total % 10 == 0, 9 <= len(d) <= 15][k]

    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, t) if fits(k, m.group()))
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_base_spans(spark, made_documents):
    rng = np.random.default_rng(5)
    signs = list("aB1234567890.._%+-@ ()xé\U0001f600 \n")
    texts = [t for _, t in made_documents] + ["".join(rng.choice(signs, rng.integers(0, 90))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8", "4111-1111-1111-11114111", "5 " * 5000, "1" * 9000, "a" * 20000 + "@b.c", "+" + "1 " * 9, "0255.1.1.1", "00256.1.1.1", "1 " * 9000 + "4111111111111111"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", private.span_text(private.base_spans(F.col("t"))).alias("s"))
    assert all(r["s"] == spans(r["t"]) for r in df.collect())


def test_contexts_reveal_identifiers(spark, odd_documents, no_documents):
    rows = [f"note {k} reach me at phone: +1 (555) 555-{1000 + k} today please" for k in range(30)]
    rows += [f"reach me at phone: 555-{2000 + k} today thanks" for k in range(4)] + ["the 12345 cats", "the 9x9 dogs"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in private.find(df).collect()}
    assert all([s["kind"] for s in got[k]["added"]] == [3] for k in range(30, 34)) and not got[34]["added"] and not got[35]["added"]
    assert rows[30][got[30]["added"][0]["start"] : got[30]["added"][0]["end"]] == "555-2000"
    clean = {r["doc_id"]: r["text"] for r in private.redacted_documents(df).collect()}
    assert clean[0] == "note 0 reach me at phone: <phone> today please" and clean[30] == "reach me at phone: <phone> today thanks" and clean[34] == rows[34]
    out = private.redacted_documents(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    assert out.where("doc_id = 10").first()["text"] == "mail <email> or <phone>, <ip> and <card>!"
    assert private.find(no_documents).count() == 0 and private.redacted_documents(no_documents).count() == 0


def test_more_unknown_than_known_and_rounds(spark):
    """Patterns of one and of two words; what one round reveals makes further patterns good."""
    rows = [f"note {k} reach me at phone: +1 (555) 555-{1000 + k} today" for k in range(12)]
    rows += [f"he said phone: 555-{2000 + k} again" for k in range(60)]
    rows += [f"or by fax line {n} soon" for n in [*(f"555-{2000 + k}" for k in range(20)), *(f"x77-{k}" for k in range(5))]]
    rows += ['key token = "' + hashlib.sha1(bytes([k])).hexdigest() + '" end' for k in range(9)] + [f'KEY TOKEN = "QX{k}-77-ABC"!! END' for k in range(4)]
    rows += ["the fax of the day by the year 1999 and the line of the house"] * 3 + [f"in room 1{k}77 of the house" for k in range(9)]
    rows += [None, ""] + [f"mail user{k}@mail.example.org please" for k in range(4)]
    df = spark.createDataFrame([(None if k % 7 == 0 else k // 2, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = Counter((r["text"], private.NAMES[a["kind"]], r["text"][a["start"] : a["end"]]) for r in found_texts(df) for a in r["seeds"] + r["revealed"])
    want = Counter((t, "phone", t.split()[3]) for t in rows[12:72]) + Counter((t, "phone", t.split()[4]) for t in rows[72:97])
    want += Counter((t, "secret", t.split('"')[1]) for t in rows[97:110])
    assert got == want
    # the same by plain Python
    keyed = private.with_rows(df)
    mention = keyed.select(F.explode(private.mentions(F.coalesce("text", F.lit("")))).alias("m")).select("m.*").collect()
    plain = bootstrap([(m["instance"], m["kind"], [p for p in m["patterns"] if p]) for m in mention], [t or "" for t in rows])
    again = private.bootstrap(spark.createDataFrame(mention, "start int, end int, kind int, instance string, patterns array<string>"), keyed.select(F.coalesce("text", F.lit("")).alias("text")))
    assert {r["instance"]: r["kind"] for r in again.collect()} == plain and len(plain) == 60 + 5 + 4


def found_texts(df):
    rows = private.with_rows(df)
    return rows.join(private.find_rows(rows), "_row").collect()


def bootstrap(mentions, texts):
    counts = Counter(re.sub("[0-9]+", "9", w) for t in texts for w in t.lower().split())
    times, of_pattern = Counter(), {}
    for instance, kind, patterns in mentions:
        for p in patterns:
            times[p, instance, kind] += 1
            of_pattern.setdefault(p, set()).add(instance)
    wide = {p for p, xs in of_pattern.items() if len(xs) > private.LEAST_KNOWN}
    every = {p: sum(n for (q, _, _), n in times.items() if q == p) for p in wide}
    total = {p: max(min(counts[w] for w in p[1:].split(" ")), every[p]) for p in wide}
    known = {}
    for (p, instance, kind), _ in sorted(times.items(), key=str):
        if p in wide and kind is not None:
            known[instance] = min(kind, known.get(instance, kind))
    found = {}
    while True:
        free = {p: sum(n for (q, x, _), n in times.items() if q == p and x not in known) for p in wide}
        good = {}
        for p in wide:
            for k in set(known.values()):
                held = {x: n for (q, x, _), n in times.items() if q == p and known.get(x) == k}
                score = sum(n for (q, x, _), n in times.items() if q == p and x in held) / (total[p] - free[p] + 1)
                if free[p] and len(held) >= private.LEAST_KNOWN and score >= private.GOOD_CONTEXT:
                    good[p, k] = min(score, 0.9999)
        scored = {}
        for x in {x for (q, x, _) in times if x not in known}:
            for (p, k), score in good.items():
                if x in of_pattern[p]:
                    scored[x, k] = 1 - (1 - scored.get((x, k), 0)) * (1 - score)
        new = {}
        for (x, k), score in sorted(scored.items(), key=lambda s: (s[1], -s[0][1])):
            if score >= private.GOOD_INSTANCE:
                new[x] = k
        if not new:
            return found
        found |= new
        known |= new


def test_rounds_go_on_until_none_reveals_more(spark):
    """A chain: each round's instances make the next pattern good."""
    rows = [f"step0 +1 (555) 555-{1000 + k} end" for k in range(5)]
    for r in range(7):
        rows += [f"step{'x' * r} id-{r}-{k} end{'y' * r}" for k in range(4)] + [f"step{'x' * (r + 1)} id-{r}-{k} end{'y' * (r + 1)}" for k in range(4)]
    rows += [f"step +1 (555) 555-{1000 + k} fin" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = private.find(df).collect()
    assert {rows[r["doc_id"]][s["start"] : s["end"]] for r in found for s in r["added"]} == {f"id-{r}-{k}" for r in range(7) for k in range(4)}
    assert all(r["n_revealed"] == len(r["added"]) for r in found)


def test_long_texts_take_linear_time(spark):
    texts = ["12345 " * 170_000, "1.2.3.4 " * 60_000, "a@b.cd " * 60_000, "call +1 (555) 555-0100 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    found = private.find(df).select("doc_id", F.size("base").alias("n"), F.size("added").alias("m"), F.try_element_at("base", F.lit(-1)).alias("last")).orderBy("doc_id").collect()
    assert [(r["n"], r["m"]) for r in found] == [(0, 0), (60_000, 0), (60_000, 0), (20_000, 0)] and time.time() - began < 120
    assert [(r["last"]["start"], r["last"]["end"]) for r in found[1:]] == [(8 * 60_000 - 8, 8 * 60_000 - 1), (7 * 60_000 - 7, 7 * 60_000 - 1), (23 * 20_000 - 18, 23 * 20_000 - 1)]


def test_mixing(spark, odd_documents, no_documents):
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "b", "c", None][min(3, int(rng.zipf(1.7)) - 1)], int(rng.integers(0, 60))) for i in range(900)] + [(5000, "a", 4000), (5000, "a", 4000)]
    sized = mixing.keyed(mixing.settle(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "_row long, doc_id long, source string, size long"), "sized"))
    ends = {r["source"]: r for r in mixing.stops(sized, buckets=16).collect()}
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    left, open_, target = 1.5 * sum(total.values()), dict(zip(["a", "b", "c", None], [3, 1, 2, 3])), {}
    while True:  # share, cap, share the excess again
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            del open_[s]
    assert all(np.isclose(ends[s]["target"], target[s]) and ends[s]["source_size"] == total[s] for s in total)
    got = mixing.mix(sized, spark.createDataFrame(list(ends.values()), "source string, source_size long, target double, certain long, rate double, stop double"), F.col("size"), "_key").collect()
    taken = Counter()
    for r in got:
        assert r["_mix"]["copies"] in (0, 1, 2)
        taken[r["source"]] += r["size"] * r["_mix"]["copies"]
    assert all(abs(taken[s] - target[s]) <= (4000 if s == "a" else 60) for s in total)
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() > 0 and mixing.mixed_documents(no_documents).count() == 0


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: k % 2, lambda k: None if k % 2 else k])
def test_mixing_meets_its_targets_with_null_and_shared_ids(spark, ids):
    rows = [(ids(k), "word " * 100, "abc"[k % 3]) for k in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = Counter(r["source"] for r in mixing.mixed_documents(df).collect())
    share = 1.5 * 18_000 / 6  # the first source stops at twice its size, the others share the rest
    targets = {"a": 12_000, "b": (27_000 - 12_000) / 3, "c": 2 * (27_000 - 12_000) / 3}
    assert share * 3 > 12_000 and all(abs(100 * taken[s] - targets[s]) <= 100 for s in "abc")


def test_near_duplicates(spark, odd_documents, no_documents, monkeypatch):
    rng = np.random.default_rng(6)
    docs = []
    for _ in range(30):
        base = [f"v{x}" for x in rng.integers(0, 4000, rng.integers(1, 120))]
        for _ in range(rng.integers(1, 6)):
            words = list(base)
            for _ in range(rng.integers(0, 5)):
                words[rng.integers(len(words))] = f"n{rng.integers(9999)}"
            docs.append(" ".join(words))
    docs += [r["text"] for r in odd_documents.orderBy("doc_id").collect()]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in docs]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    want = [(i, len(s), root(i), root(i) == i, root(i) == i) for i, s in enumerate(sets)]
    for size in (2, 3, 512):
        monkeypatch.setattr(minhash, "BLOCK_MEMBERS", size)
        assert [tuple(r) for r in minhash.near_duplicates(df).orderBy("doc_id").collect()] == want
    kept = minhash.kept_documents(odd_documents)
    assert kept.columns == odd_documents.columns and minhash.near_duplicates(no_documents).count() == 0


def test_near_copies_and_templates_take_near_linear_work(spark, monkeypatch):
    """A large group of near copies, and texts that share the same half."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 100_000, n)]
    base, half = word(100), word(60)
    near = []
    for _ in range(120):
        words = list(base)
        words[rng.integers(100)] = f"n{rng.integers(9999)}"
        near.append(" ".join(words))
    docs = near + [" ".join(half + word(40)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 10)
    seen = spark.sparkContext.accumulator(0)
    plain = minhash.forest

    def counting(nodes, *args):
        seen.add(len(nodes))
        return plain(nodes, *args)

    monkeypatch.setattr(minhash, "forest", counting)
    rows = minhash.near_duplicates(df).orderBy("doc_id").collect()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in docs]
    groups = {}
    for i, j in itertools.combinations(range(240), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            merged = groups.get(i, {i}) | groups.get(j, {j})
            groups.update(dict.fromkeys(merged, merged))
    assert [r["component_id"] for r in rows] == [min(groups.get(i, {i})) for i in range(240)]
    assert seen.value < 3 * 240  # all pairs of blocks would bring 12 * 240


def test_one_row_of_each_group_stays(spark):
    """Null ids, ids that rows share, and repeated rows."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, base), (None, base), (None, base.replace("w30", "x30")), (None, "alone and without an id but never lost"), (None, None), (None, ""),
        (2, "shared id first text of its own kind"), (2, base + " w60"), (2, "shared id other text that nothing is like"),
        (3, "the same row twice over and over"), (3, "the same row twice over and over"),
        (None, base.upper().replace("W", "v")), (None, base.replace("w", "v")), (None, base.replace("w", "v").replace("v10", "y10")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, minhash.kept_documents(df).collect()))
    v = [r for r in kept if r[1] and r[1].lower().startswith("v0 ")]
    assert len(v) == 1 and v[0][0] is None and kept.pop(v[0]) == 1
    assert kept == Counter([rows[0], *rows[3:7], *rows[8:10]])
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept", "stands"] and got.count() == len(rows) and got.where("stands").count() == 8
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got.collect())
    assert got.where("component_id = 1").count() == 4


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {}
    for a, b in pairs:
        members = parent.get(a, {a}) | parent.get(b, {b})
        for m in members:
            parent[m] = members
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in parent.items() if len(v) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(9)
    for overlap in (0, 50, 150, 300):
        x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        y = np.concatenate([x[:overlap], rng.integers(0, 1 << 63, 300 - overlap).astype(np.uint64)])
        assert abs((minhash.signature(x) == minhash.signature(y)).mean() - overlap / (600 - overlap)) < 0.08
    assert minhash.miss_chance() < 1e-5 and shingles.shingle_sets(pa.array([None, "a b", "A b"]))[1].tolist() == shingles.shingle_sets(pa.array(["A  b"]))[0].tolist()


@pytest.mark.parametrize("held", [3_000, 20_000_000])
def test_quality(spark, odd_documents, no_documents, odd_labels, monkeypatch, held):
    monkeypatch.setattr(quality, "HELD_PLACES", held)  # long samples are learned from in parts
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "over", "green", "hills"], 40))
    make = [lambda: " ".join(w + "!!" for w in good().upper().split()), lambda: good() + " awful awful", lambda: good() + " fine day"]
    rows = [(i, make[i % 3](), i % 3) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i < 400], "doc_id long, g int")
    got = {r["doc_id"]: r for r in quality.graded(docs, labels, 3, F.col("g")).collect()}
    held = [(g, got[i]) for i, _, g in rows if i >= 400]
    assert np.mean([r["kept"] == (g > 0) for g, r in held]) > 0.98
    assert np.mean([r["expected_grade"] for g, r in held if g == 2]) > np.mean([r["expected_grade"] for g, r in held if g == 1]) > np.mean([r["expected_grade"] for g, r in held if g == 0])
    kept = quality.kept_documents(odd_documents, odd_labels)
    assert kept.columns == odd_documents.columns
    assert quality.graded(odd_documents, odd_labels).count() == odd_documents.count() and quality.graded(no_documents, odd_labels).count() == 0
    assert quality.kept_documents(odd_documents, odd_labels.limit(0)).count() == odd_documents.count()


def test_thresholds_stay_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    places, counts, grades = np.where(x > 0, 1, 2).astype(np.int32), np.ones(400, np.int64), np.clip(np.digitize(x, [-0.5, 0.5]), 0, 2)
    w, t = quality.descend(places, counts, grades, np.zeros(8), np.array([-0.5, 0.5]), 5, 0.3, 0)
    assert t[0] < t[1] and w[1] > w[2] and (np.diff(quality.tails(np.array([0.3]), t), axis=1) <= 0).all()


def test_decoding_disguises(spark):
    text = " ".join(["the idiot and the stupid moron are worthless and pathetic in the garden of the house"] * 50)
    model = toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([(text,), (None,)], "text string")))
    r = toxicity.Restorer(model)
    assert [r.word(w) for w in ("1d10t", "st*pid", "m0r0n", "idiooot", "p@thetic", "garden")][0::2] == ["idiot", "moron", "pathetic"]
    assert r.word("idiooot") == "idiot" and r.word("garden") == "garden"
    assert "moron" in r.spelled("you m o r o n go")
    assert "moron" in r.spelled("you\nm\no\nr \no\tn\ngo") and r.spelled("an e e n") and not r.spelled("- - - -") and not r.spelled("a b")


def all_readings(signs, model):
    """Every path through a lattice with its score, by plain recursion."""

    def go(k, a, b, last, score, out):
        if k == len(signs):
            yield score + model[a][b][0], out
            return
        sign = signs[k]
        options = [(sign, 0.0)] if sign != " " else [(" ", 0.0), ("", toxicity._JOIN_COST)]
        looks = toxicity.LOOKS.get(sign)
        options += [(x, toxicity._LOOK_COST) for x in looks or ""] + ([("", toxicity._LOOK_COST)] if looks == "" else [])
        for x, cost in options:
            if x == "":
                yield from go(k + 1, a, b, last, score + cost, out)
                continue
            c = toxicity._symbol(x)
            yield from go(k + 1, b, c, x, score + cost + model[a][b][c], out + x)
            if x == last and x.isalpha():
                yield from go(k + 1, a, b, last, score + cost + toxicity._DROP_COST, out)

    return go(0, 0, 0, "", 0.0, "")


def test_decoding_finds_the_best_of_all_readings():
    rng = np.random.default_rng(5)
    for round_ in range(3):
        model = toxicity.log_model(rng.integers(0, 50, 28**3).astype(float) ** (1 + round_)).tolist()
        for _ in range(60):
            signs = list(rng.choice(list("aabbio013$!|*_é7 "), rng.integers(1, 8)))
            scores = {}
            for score, out in all_readings(signs, model):
                scores[out] = max(score, scores.get(out, -np.inf))
            assert scores[toxicity.decode(signs, model)] == pytest.approx(max(scores.values()))


def test_every_form_of_disguise_is_read(spark):
    text = " ".join(["the idiot and the stupid moron are worthless and pathetic as an ass in the garden of the house"] * 50)
    r = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([(text,)], "text string"))))
    forms = {
        "idiot": ["!d10t", "!diot", "iidiot", "idiot!!", "(!d10t)", "1d!0t", "!d!0t!", "id" + "i" * 60 + "ot", "!d" + "i" * 60 + "0t"],
        "stupid": ["$tupid", "stuupid", "*$tup1d*", "$tupid!", "s" + "t" * 50 + "upid"],
        "ass": ["a$$", "455", "a55", "@$$", "a$$!", "\"a$$\","],
    }
    assert {f: w for w, fs in forms.items() for f in fs if w not in r.readings(f)} == {}
    assert any("stupid" in w for w in r.readings("st*pid-$tupid-" * 9)) and r.readings("garden.") == ["garden"] and r.readings("...") == []


def test_toxicity(spark, odd_documents, no_documents, odd_labels):
    rng = np.random.default_rng(7)
    calm = ["river", "stone", "green", "hills", "walk", "house", "garden"]
    rows = []
    for i in range(500):
        words = list(rng.choice(calm, 30))
        if i % 4 == 0:
            words[rng.integers(30)] = "moron"
        rows.append((i, " ".join(words)))
    rows += [(1000, "green m0r0n hills"), (1001, "m o r o n in the garden"), (1002, "green hills"), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, F.col("toxic")).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 500)) and got[1000] > 0.5 and got[1001] > 0.5 and got[1002] < 0.5 and got[1003] < 0.5
    scored = toxicity.toxicity(odd_documents, odd_labels, F.col("toxic"))
    assert scored.count() == odd_documents.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(no_documents, odd_labels, F.col("toxic")).count() == 0


def test_null_and_shared_ids_everywhere(spark, odd_labels):
    """Every row has its own result, whatever its id."""
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (1, "first text of the id"), (1, "second text of the id"), (2, "")]
    df = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long").repartition(2)
    ids = Counter(d for d, _ in rows)
    count = lambda found: Counter(r["doc_id"] for r in found.select("doc_id").collect())
    for found in (
        quality.graded(df, odd_labels), substrings.remove_repeats(df), media.fingerprint(media.to_wav(df)), weighted.compare_with_next(df), private.find(df),
        minhash.near_duplicates(df), toxicity.toxicity(df, odd_labels, F.col("toxic")), packing.pack(df, BYTES).where("start = 0"),
    ):
        assert count(found) == ids, found.columns
    framed = frames.read_frames(frames.write_frames(df, WORDS, 2, shards=2)).orderBy("start").collect()
    assert [r["doc_id"] for r in framed] == [None] * 3 + [1, 1, 2] and [r["start"] for r in framed] == list(itertools.accumulate((r["n_tokens"] for r in framed[:-1]), initial=0))
    assert Counter(r["ids_crc32"] for r in framed) == Counter(zlib.crc32(ids_of(WORDS, t or "", 2).tobytes()) for _, t in rows)
    assert {r["doc_id"] for r in mixing.mixed_documents(df).collect()} <= set(ids)
    assert len(minhash.kept_documents(df).collect()) == 5 and private.redacted_documents(df).count() == 6


def test_quality_scores_as_plain_python(spark):
    """Places, repeats and tails of every text by their definition, whole words and shapes of any length."""
    rng = np.random.default_rng(2)
    long = "ab1!" * 12
    texts = [None, "", "one", "Go go go", f"{long} {long}X9 {long}x9", "The 2nd  THE\n2nd!", *(" ".join(rng.choice(["aa", "Bb", "c1", "c2", "DD"], 30)) for _ in range(40))]
    weights, thresholds = rng.normal(size=quality.PLACES), np.array([-0.4, 0.7])
    rows = quality.grade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights, thresholds).collect()
    place = lambda part: xxhash.xxh32_intdigest(part) % quality.PLACES
    for r in rows:
        words, total = (texts[r["doc_id"]] or "").split() or [""], 0.0
        for k, w in enumerate(words):
            shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "a", w))
            again = k > 0 and words[k - 1] == w
            total += weights[place(w.lower())] + weights[place("\x00" + shape)] + weights[place("\x01again" if again else "\x01new")]
        score = total / math.sqrt(3 * len(words))
        tail = [1 / (1 + math.exp(t - score)) for t in thresholds]
        assert np.isclose(r["score"], score, atol=1e-4) and np.allclose(r["tail"], tail, atol=1e-4) and np.isclose(r["expected_grade"], sum(tail), atol=1e-4)
    a, b = (quality.hashed(pa.array([f"x{'-' * 30}{end}"]))[0][1] for end in ("!", "?"))
    assert a != b


def test_labelled_sample_is_bounded_and_settled(spark):
    from gaugeline.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(k % 3, f"t{k}") for k in range(90)] + [(None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (7, 1), (None, 1)], "doc_id long, g int")
    found = [sorted(map(tuple, labelled_sample(docs.repartition(n), labels.repartition(n), F.col("g")).collect())) for n in (1, 3)]
    assert found[0] == found[1] and sorted(g for _, g in found[0]) == [0, 1]


def test_bands_after_the_first_tie_what_those_left_apart(spark):
    """The components of all bands, from fewer ties: near copies are tied by the first bands alone."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 40, minhash.BANDS)
    rows = []
    for node in range(240):
        bands = rng.integers(1 << 41, 1 << 42, minhash.BANDS)
        if node < 120:  # near copies: most bands are the centre's
            bands = np.where(rng.random(minhash.BANDS) < 0.9, centre, bands)
        elif node < 200:  # chains by one band, early or late
            # a key belongs to one band
            bands[node // 2 % minhash.BANDS] = (1 << 50) + node // 2
            bands[node // 10 % minhash.BANDS] = (1 << 51) + node // 10
        rows.append((node, bands.tolist()))
    banded = spark.createDataFrame(rows, "node long, bands array<long>")
    keyed = banded.select("node", F.explode("bands").alias("band"))
    plain = lambda edges: sorted(map(tuple, components.components(edges.select("node", "least")).collect()))
    joined = minhash._joined(banded)
    assert plain(joined) == plain(minhash._ties(keyed))
    ties = lambda bands: minhash._ties(bands).agg(F.sum("bands")).first()[0]
    first = joined.where("node < 120").count()
    assert first < ties(keyed) / 4


def test_narrow_keys_of_one_member_alone_are_not_shuffled(spark):
    """Keys that two members have all come out, and few others; ties and their bands are those of all keys."""
    rng = np.random.default_rng(5)
    bands = rng.integers(-(1 << 62), 1 << 62, (300, minhash.NARROW_BANDS))
    centre = rng.integers(-(1 << 62), 1 << 62, minhash.NARROW_BANDS)
    bands[:150] = np.where(rng.random((150, minhash.NARROW_BANDS)) < 0.1, centre, bands[:150])
    banded = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(bands)], "node long, bands array<long>").repartition(5)
    keyed = banded.select("node", F.explode("bands").alias("band"))
    found = minhash._shared_keys(banded).collect()
    values, n = np.unique(bands, return_counts=True)
    tied = set(values[n > 1].tolist())
    want = {(k, int(x)) for k, row in enumerate(bands) for x in row if int(x) in tied}
    assert want <= set(map(tuple, found)) and len(found) == len(set(found)) < len(want) + 0.02 * bands.size
    plain = lambda rows: sorted(map(tuple, minhash._ties(rows).collect()))
    assert plain(minhash._shared_keys(banded)) == plain(keyed)
    assert minhash._shared_keys(banded.limit(0)).count() == 0


def test_members_of_a_large_cluster_make_a_row_each(spark, monkeypatch):
    """Near copies share most narrow keys: none of the tables on the way has a row a key."""
    rng = np.random.default_rng(9)
    base = [f"t{x}" for x in rng.integers(0, 100_000, 200)]
    docs = []
    for _ in range(300):
        words = list(base)
        words[rng.integers(200)] = f"n{rng.integers(99999)}"
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    plain, rows = minhash.settle, {}

    def counting(table, name, **options):
        out = plain(table, name, **options)
        rows[name] = max(out.count(), rows.get(name, 0))
        return out

    monkeypatch.setattr(minhash, "settle", counting)
    found = minhash.near_duplicates(df).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 300
    narrow = list(rows).index("heavy-sets")
    assert rows["verified-ties"] and max(list(rows.values())[narrow:]) <= minhash.LEADERS * 300


@pytest.mark.parametrize("meet", [4096, 60])
def test_members_meet_as_all_keys_tie_them(spark, monkeypatch, meet):
    rng = np.random.default_rng(5)
    bands = rng.integers(-(1 << 62), 1 << 62, (300, minhash.NARROW_BANDS))
    centre = rng.integers(-(1 << 62), 1 << 62, minhash.NARROW_BANDS)
    bands[:150] = np.where(rng.random((150, minhash.NARROW_BANDS)) < 0.1, centre, bands[:150])
    bands[200:220, 7] = 12345
    sets = spark.createDataFrame([(3 * k, b"", row.tolist()) for k, row in enumerate(bands)], "node long, grams binary, bands array<long>").repartition(5)
    monkeypatch.setattr(minhash, "MEET", meet)
    ties = minhash._ties(sets.select("node", F.explode("bands").alias("band"))).collect()
    met = minhash._met(sets.select(F.lit(0).cast("long").alias("wide"), "node"), sets).collect()
    assert sorted(r["node"] for r in met) == list(range(0, 900, 3))
    heads = spark.createDataFrame([(r["node"], r["heads"]) for r in met if r["heads"]], "node long, bands array<long>")
    more = minhash._ties(minhash._shared_keys(heads)).select("node", "least")
    plain = lambda edges: sorted(map(tuple, components.components(spark.createDataFrame(edges, "node long, least long")).collect()))
    assert plain([(r["node"], r["tied"]) for r in met] + [tuple(r) for r in more.collect()]) == plain([(r["node"], r["least"]) for r in ties])
    if meet == 4096:
        best = {r["node"]: sorted((-x["bands"], x["least"]) for x in ties if x["node"] == r["node"]) for r in met}
        assert all(r["leaders"] == [b for _, b in best[r["node"]][: minhash.LEADERS]] and r["shared"] == (-best[r["node"]][0][0] if best[r["node"]] else None) for r in met)
        assert heads.isEmpty()
    else:
        assert minhash._shared_keys(heads).count() < minhash._shared_keys(sets).count() / 2
