"""Operators that compare documents with one another, and the archives, against brute force and on odd rows."""

import hashlib
import random

import numpy as np
import xxhash

from prefixloom.llm import repeats, simhash, warc
from prefixloom.llm.components import components
from prefixloom.llm.suffix_array import neighbours, suffix_array

ODD = [None, "", " ", "a", "a b c d", "x" * 30_000, "word " * 9_000, "é 漢 😀 \x00 b", "Tab\tand\x0bLINE\x0c\r\n"]


def odd(spark):
    rows = [(k, t, 1, "s") for k, t in enumerate(ODD)] + [(None, "null id", 1, "s"), (1, "", 1, "s"), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, anchor string")


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for _ in range(5000):
        text = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 14))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for _ in range(50):
        text = [rng.randint(0, 2) for _ in range(rng.randint(50, 200))] * rng.randint(1, 2)
        order = suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])

        def shared(a, b):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            return k

        got = neighbours(text, order)
        for i in rng.sample(range(len(text)), 5):
            assert got[i] == max(shared(i, j) for j in range(len(text)) if j != i)


def brute_repeats(texts, window=200):
    places, covered = {}, [bytearray(len(d)) for d in texts]
    for k, d in enumerate(texts):
        for s in range(len(d) - window + 1):
            places.setdefault(d[s : s + window], []).append((k, s))
    for found in places.values():
        for k, s in found if len(found) > 1 else ():
            covered[k][s : s + window] = b"\1" * window
    out = []
    for d, c in zip(texts, covered):
        kept = bytes(x for x, gone in zip(d, c) if not gone)
        out.append((len(d), sum(c), sum(c[i] and (i == 0 or not c[i - 1]) for i in range(len(c))), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    rng = random.Random(2)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(700)) for _ in range(4)]
    texts = []
    for _ in range(60):
        b, kind = rng.choice(base), rng.random()
        if kind < 0.15:
            texts.append(b)
        elif kind < 0.5:
            x = bytearray(b)
            for _ in range(rng.randint(1, 4)):
                x[rng.randrange(len(x))] = ord("X")
            texts.append(bytes(x))
        elif kind < 0.75:
            i = rng.randrange(450)
            texts.append(bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 150))) + b[i : i + rng.randint(150, 250)] + b"q" * rng.randint(0, 300))
        else:
            texts.append(b"ab " * rng.randint(1, 200) + b[: rng.randint(0, 250)])
    return [(k, t.decode()) for k, t in enumerate(texts)] + [(3, texts[3].decode()), (None, texts[5].decode()), (777, None), (778, "")]


def test_repeats_against_brute_force(spark, monkeypatch):
    rows = repeat_rows()
    want = sorted((str(i), *r) for (i, _), r in zip(rows, brute_repeats([(t or "").encode() for _, t in rows])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (repeats.PART, 3):  # with 3, most anchors are too hot for one task
        monkeypatch.setattr(repeats, "PART", part)
        assert sorted((str(r[0]), *r[1:5]) for r in repeats.remove_repeats(docs).collect()) == want


def test_sorted_content_decides_all_but_anchors_of_one_kind(spark, monkeypatch):
    """Without the suffix array's answers only segments go whose anchor has no other kind; the rest, more than half here, is decided by sorting."""
    docs = spark.createDataFrame(repeat_rows(), "doc_id long, text string")
    removed = lambda: repeats.remove_repeats(docs).agg({"n_removed": "sum"}).first()[0]
    every = removed()
    monkeypatch.setattr(repeats, "neighbours", lambda text, order: [0] * len(text))
    exits = [removed()]
    monkeypatch.setattr(repeats, "PART", 3)
    exits.append(removed())
    assert exits[0] == exits[1] < every / 2


def test_bodies_of_repeated_rows_are_fetched_once(spark):
    rows = [(7, "x" * 150 + "a long text that many rows share " * 12)] * 400 + [(8, "a long text that many rows share " * 12 + "y" * 300)] + [(None, "a long text that many rows share " * 9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) body_key")
    assert repeats._one_of_each(keyed).count() == 3
    want = sorted((str(i), *r) for (i, _), r in zip(rows, brute_repeats([t.encode() for _, t in rows])))
    assert sorted((str(r[0]), *r[1:5]) for r in repeats.remove_repeats(docs).collect()) == want


def test_slabs_give_what_whole_texts_give(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    spans = lambda: [(a + k) for _, _, a, n, _ in zip(*repeats.Hasher().segments(data)) for k in range(n)]
    whole = spans()
    monkeypatch.setattr(repeats, "SLAB", 512)
    assert spans() == whole == list(range(3000 - repeats.WINDOW + 1))


def test_repeats_on_odd_rows(spark):
    got = repeats.remove_repeats(odd(spark)).collect()
    assert len(got) == odd(spark).count() and {r.doc_id: r.n_removed for r in got}[5] == 30_000
    assert repeats.remove_repeats(odd(spark).limit(0)).count() == 0


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["Ab", "c", "É", " ", " ", "\t", "\n", "dd"]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    prints = {}
    for k in range(300):
        base = rng.getrandbits(64) if k < 20 or rng.random() < 0.2 else prints[rng.randrange(k)]
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        prints[k] = base
    want = brute_components(prints)
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), k) for v, k in {v: k for k, v in sorted(prints.items(), reverse=True)}.items()], "fp long, rep long")
    for part, blocks in ((4096, None), (5, 6), (4096, 7), (4096, 8)):  # with 5, buckets are dealt out as pairs of parts
        monkeypatch.setattr(simhash, "PART", part)
        found = {r.node: r.component for r in components(simhash.links(rows, blocks)).collect()}
        by_print = {}
        for k, v in prints.items():
            by_print.setdefault(v, []).append(k)
        assert all(found.get(min(by_print[v]), min(by_print[v])) == want[k] for k, v in prints.items())


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_on_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    prints = {k: brute_fingerprint(t) for k, t in enumerate(ODD)}
    want = brute_components(prints)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    once = simhash.first_of_group(odd(spark))
    assert once.columns == odd(spark).columns and sorted(r.doc_id for r in once.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_first_of_group_on_shared_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, c), (5, c), (None, d), (None, d), (None, c), (None, "e f"), (5, None), (None, None)]
    once = simhash.first_of_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, once.collect())) == sorted(map(str, spark.createDataFrame([(3, a), (5, b), (5, c), (None, d), (None, "e f"), (5, None)], "doc_id long, text string").collect()))


def pages(spark):
    rows = [(k, f"http://x/{k} a\n", t, "s") for k, t in enumerate(ODD)] + [(20, None, "a", "s"), (21, "u", "a", "s"), (None, "u", "a", "s"), (None, "v", "only", "s"), (5, "u", "x" * 30_000, "s")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_archives_round_trip(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "w"), block_bytes=200, blocks=2)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.gap is None for r in rows) and len(rows) == pages(spark).count()
    last = {}
    for p in pages(spark).collect():
        if p.page_id is not None:
            last[p.html or ""] = max(p.page_id, last.get(p.html or "", -1))
    want = []
    for p in pages(spark).collect():
        body = (p.html or "").encode()
        target = last.get(p.html or "")
        first = target is None or p.page_id == target
        want.append((str(p.page_id), len(body), warc.sha1_base32(body), "response" if first else "revisit", None if first else target))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(want, key=lambda x: x[:4])
    assert all(r.payload == (next(p.html for p in pages(spark).collect() if p.page_id == r.page_id) or "").encode() for r in rows if r.record_type == "response" and r.page_id is not None)


def test_empty_archives(spark, tmp_path):
    warc.write_archives(pages(spark).limit(0), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_salvage_goes_on_after_damage():
    rng = random.Random(6)
    for packed in (True, False):
        parts = [warc.record(k, "u", bytes(rng.randrange(256) for _ in range(400)), None) for k in range(8)]
        parts = [warc.member(p) for p in parts] if packed else parts
        for broken in range(8):
            data = [bytearray(p) for p in parts]
            place = len(data[broken]) - 60 if not packed else len(data[broken]) // 2
            data[broken][place] ^= 0xFF
            whole = b"".join(map(bytes, data))
            found = list(warc.salvage(whole))
            ids = [int(f.fields["warc-record-id"][10:-1]) for f in found if f.reason is None]
            gaps = [(f.start, f.end) for f in found if f.reason]
            start = sum(map(len, parts[:broken]))
            assert ids == [k for k in range(8) if k != broken] and gaps == [(start, start + len(parts[broken]))]
    junk = b"no archive\n" + warc.member(warc.record(1, None, b"", None)) + b"\x1f\x8b\x08 cut"
    assert [f.reason is None for f in warc.salvage(junk)] == [False, True, False]
    assert list(warc.salvage(b"")) == []


def several(packed, count=5):
    rng = random.Random(7)
    records = [warc.record(k, "u", bytes(rng.randrange(256) for _ in range(300)), None) for k in range(count)]
    return records, warc.member(b"".join(records)) if packed else b"".join(records)


def ids_of(found):
    return [int(f.fields["warc-record-id"][10:-1]) for f in found if f.reason is None]


def test_salvage_inside_a_member_of_several_records():
    records, _ = several(True)
    after = warc.member(warc.record(9, "u", b"next", None))
    for broken in range(5):
        bad = [bytearray(r) for r in records]
        bad[broken][-40] ^= 0xFF
        found = list(warc.salvage(warc.member(b"".join(map(bytes, bad))) + after))
        assert ids_of(found) == [k for k in range(5) if k != broken] + [9]
        start = sum(map(len, records[:broken]))
        assert [f.inner for f in found if f.reason] == [(start, start + len(records[broken]))]


def test_salvage_of_a_member_that_is_cut_or_corrupt():
    records, whole = several(True)
    after = warc.member(warc.record(9, "u", b"next", None))
    for gone in (8, 10):  # the check sum, and with it the end of the last record
        for rest in (b"", after):
            found = list(warc.salvage(whole[:-gone] + rest))
            assert ids_of(found) == [*range(5 if gone == 8 else 4), *([9] if rest else [])]
            assert [(f.start, f.end) for f in found if f.reason] == [(0, len(whole) - gone)]
    corrupt = bytearray(whole)
    corrupt[len(whole) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(corrupt) + after))
    assert ids_of(found)[:1] == [0] and ids_of(found)[-1] == 9 and any(f.reason for f in found)


def test_salvage_takes_time_in_proportion_on_false_starts():
    import time

    records, whole = several(True, 3)
    began = time.time()
    found = list(warc.salvage((warc.MAGIC + b"\x00" * 7) * 100_000 + b"WARC/1.1\r\n" * 20_000 + whole))
    assert ids_of(found) == [0, 1, 2] and time.time() - began < 30


def test_a_gap_in_own_archives_is_an_error(spark, tmp_path, monkeypatch):
    import pytest

    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path)).count() == pages(spark).count()
    member = warc.member
    monkeypatch.setattr(warc, "member", lambda data: member(data)[:-4])
    with pytest.raises(Exception, match="a gap in"):
        warc.op9_warc(spark, str(tmp_path)).count()
