"""Nearest neighbours, URL lists and repeated passages, each against brute force."""

from __future__ import annotations

import math
from datetime import date

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenstep.llm import substring_dedup
from evenstep.llm.nearest import nearest
from evenstep.llm.substring_dedup import compact_windows, passages, repeated_passages, without_repeats
from evenstep.llm.url_filters import host_of, judge, validity_intervals
from llm_cases import CLASHING, prose


def _brute_force(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    answer = {}
    for q, a in usable:
        if q % every == 0:
            scores = [(-(a * b).sum() / math.sqrt((a * a).sum()) / math.sqrt((b * b).sum()), i) for i, b in usable if i != q and len(b) == len(a)]
            answer[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return answer


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[50][1]) for i in range(40)]
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [None] * 16), (3150, [float("nan")] * 16), (3200, [float("inf")] * 16), (None, rows[0][1])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    found = nearest(frame, rows_per_block=400, queries_per_block=8).collect()
    exact = _brute_force([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 50, 5)
    assert {r.query_id for r in found} == set(exact)
    hits = 0
    for q, best in exact.items():
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in best})
    assert hits >= 0.9 * 5 * len(exact)
    copies = sorted((r["rank"], r.vec_id) for r in found if r.query_id == 50)
    assert [i for _, i in copies] == [2000, 2001, 2002, 2003, 2004]


def test_few_or_no_candidates(spark):
    kind = "vec_id long, embedding array<float>"
    pair = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], kind)
    assert [(r["rank"], r.vec_id) for r in nearest(pair).collect()] == [(1, 1), (2, 1)]
    assert nearest(pair.limit(0)).collect() == [] and nearest(pair.where("vec_id = 0")).collect() == []


@pytest.mark.parametrize(
    "url, host",
    [
        ("https://User:pw@WWW.Example.COM:8080/a", "example.com"),
        ("http://a.b.example.org.", "a.b.example.org"),
        ("http://example.org?x=http://no.net", "example.org"),
        ("no url", None),
        (None, None),
        ("", None),
    ],
)
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "url string").select(host_of(F.col("url"))).first()[0] == host


def test_list_as_it_stood_on_the_day(spark):
    day = lambda n: date(2024, 1, n)
    entries = [
        ("bad.org", day(5), "block"), ("bad.org", day(10), "lift"), ("bad.org", day(20), "block"), ("bad.org", day(20), "allow"),
        ("ok.bad.org", day(6), "allow"), ("ok.bad.org", day(8), "lift"), (None, day(1), "block"), ("bad.org", None, "block"),
        ("bad.org", day(1), None), ("bad.org", day(2), "other"), ("BAD.org", day(5), "block"),
    ]
    listed = spark.createDataFrame(entries, "domain string, listed_on date, action string")
    asked = [(u, day(n)) for u in ("http://bad.org/x", "http://ok.bad.org", "http://x.ok.bad.org/", "http://good.org") for n in (1, 5, 6, 7, 8, 9, 10, 19, 20, 31)]
    asked += [(None, day(6)), ("http://bad.org", None), ("http://bad.org/x", day(5))]
    captures = spark.createDataFrame([(u, d, "old", 1) for u, d in asked], "url string, fetched_on date, verdict string, day int")

    def by_hand(url, when):
        if url is None or when is None:
            return "unlisted"
        labels = url.split("//")[1].split("/")[0].split(".")
        for i in range(len(labels) - 1):
            own = [(d, ["block", "allow", "lift"].index(a)) for n, d, a in entries if n and d and a in ("block", "allow", "lift") and n.lower() == ".".join(labels[i:]) and d <= when]
            if own:
                last = max(d for d, _ in own)
                action = min(a for d, a in own if d == last)
                if action < 2:
                    return ("blocked", "allowed")[action]
        return "unlisted"

    found = judge(captures, listed).collect()
    assert len(found) == len(asked)
    for r in found:
        assert r.verdict == by_hand(r.url, r.fetched_on), r
        if r.verdict != "unlisted":
            assert r.valid_from <= r.fetched_on and (r.valid_to is None or r.fetched_on < r.valid_to)
    assert {r.verdict for r in judge(captures, listed.limit(0)).collect()} == {"unlisted"}
    assert judge(captures.limit(0), listed).collect() == []
    assert [r.valid_to for r in validity_intervals(listed).where("domain = 'bad.org'").orderBy("valid_from").collect()] == [day(10), day(20), None]


def test_compact_windows_hold_every_passage_once():
    values = np.random.default_rng(1).integers(0, 1000, 60).astype(np.uint64)
    windows = compact_windows(values, 7)
    for i in range(60):
        for j in range(i + 6, 60):
            inside = [c for low, c, high in windows if low <= i <= c <= j <= high]
            assert inside == [i + int(values[i : j + 1].argmin())]


def test_passages_need_length_and_similarity():
    draw = np.random.default_rng(2)
    a, b, shared = (draw.integers(0, 2**60, n, dtype=np.uint64) for n in (80, 90, 60))
    assert passages(np.concatenate([a, shared]), np.concatenate([shared, b]), 46) == [(80, 140, 0, 60)]
    assert passages(np.concatenate([a, shared[:40]]), np.concatenate([shared[:40], b]), 46) == []
    half = shared.copy()
    half[::2] = 1
    assert passages(np.concatenate([a, half]), np.concatenate([shared, b]), 46) == []


def _meets_the_rule(a, b, width):
    """Whether any two stretches from shared shingle to shared shingle are long and similar enough (one shift only)."""
    shared = [i for i in range(len(b)) if b[i] in set(a.tolist())]
    where = {v: i for i, v in enumerate(a.tolist())}
    for s in shared:
        for e in reversed(shared):
            low, high = where[b[s]], where[b[e]] + 1
            if e + 1 - s >= width and high - low >= width:
                ours, theirs = set(b[s : e + 1].tolist()), set(a[low:high].tolist())
                if 4 * len(ours & theirs) >= 3 * len(ours | theirs):
                    return True
    return False


def test_an_edit_at_any_place_of_a_passage():
    draw = np.random.default_rng(8)

    def shingled(words):
        return np.array([hash(tuple(words[i : i + 5])) & 0xFFFFFFFFFFFFFFF for i in range(len(words) - 4)], np.uint64)

    missed = []
    for size in (50, 51, 55, 60, 75, 100):
        passage = draw.integers(0, 2**60, size).tolist()
        for at in range(size):
            for edit in ([-1], [passage[at], *range(-6, -1)], []):
                edited = passage[:at] + edit + passage[at + 1 :]
                sides = [draw.integers(0, 2**60, 30).tolist() for _ in range(4)]
                a, b = shingled(sides[0] + passage + sides[1]), shingled(sides[2] + edited + sides[3])
                found = passages(a, b, 46)
                for low, high, s, e in found:
                    ours, theirs = set(b[s:e].tolist()), set(a[low:high].tolist())
                    assert min(e - s, high - low) >= 46 and 4 * len(ours & theirs) >= 3 * len(ours | theirs)
                if _meets_the_rule(a, b, 46) and not found:
                    missed.append((size, at, len(edit)))
    assert missed == []


@pytest.mark.parametrize("schema", [None, CLASHING])
def test_repeated_passages_are_found_and_cut(documents, schema):
    passage, other = prose(77, 70), prose(78, 64)
    words = passage.split(" ")
    edited = " ".join([*words[:35], "changed", *words[36:]])
    texts = [
        prose(1, 90) + "\n" + passage + " " + prose(2, 80),
        prose(3, 60) + " " + passage.upper().replace(" ", "  ") + "\n\n" + prose(4, 70),
        prose(5, 70) + " " + other,
        other + " " + prose(6, 50),
        prose(7, 100),
        prose(8, 50) + " " + " ".join(words[:40]) + " " + prose(9, 50),
        prose(10, 50) + " " + edited + " " + prose(11, 50),
        passage,
        None,
        "",
        "few words",
    ]
    rows = [*enumerate(texts), (4, prose(7, 100)), (None, passage), (900, prose(12, 20_000))]
    frame = documents(rows, **({"schema": schema} if schema else {}))
    found = {(r.doc_id, r.kept): (r.start_word, r.end_word, r.first_doc_id) for r in repeated_passages(frame).collect()}
    assert found == {
        (0, True): (90, 160, 0), (1, False): (60, 130, 0), (6, False): (50, 120, 0), (7, False): (0, 70, 0),
        (2, True): (70, 134, 2), (3, False): (0, 64, 2),
    }
    cut = without_repeats(frame)
    assert cut.columns == frame.columns
    left = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert left == {i: t for i, t in rows if i not in (1, 3, 6, 7, None)} | {
        1: prose(3, 60) + " " + prose(4, 70), 3: prose(6, 50), 6: prose(10, 50) + " " + prose(11, 50),
    }
    assert cut.where("doc_id is null").count() == 1 and cut.count() == len(rows) - 1
    assert cut.where("n_chars != length(text)").count() == 0
    assert repeated_passages(frame.limit(0)).collect() == []


def test_a_passage_that_stands_in_two_places(documents):
    twice = prose(5, 60)
    frame = documents([twice + " " + prose(6, 300) + " " + twice, prose(7, 20) + " " + twice, twice + " " + twice])
    spans = {(r.doc_id, r.kept): (r.start_word, r.end_word) for r in repeated_passages(frame).collect()}
    assert spans[(1, False)] == (20, 80) and (2, False) in spans and (0, True) in spans
    draw = np.random.default_rng(6)
    one, two = (draw.integers(0, 2**60, 60, dtype=np.uint64) for _ in range(2))
    swapped = passages(np.concatenate([two, draw.integers(0, 2**60, 400, dtype=np.uint64), one]), np.concatenate([one, two]), 46)
    assert all(0 <= low < high <= 520 and 0 <= s < e <= 120 for low, high, s, e in swapped)


def test_partners_beyond_the_first_document(documents, monkeypatch):
    """Parts of a passage in earlier documents do not hide it in later ones, in one block of a bucket or in many."""
    texts = []
    for case in range(12):
        words = prose(900 + case, 54).split(" ")
        edited = [*words[:27], "changed", *words[28:]]
        for k, part in enumerate([words[:27], words[27:], words[5:49], words, words, edited]):
            seed = 10_000 + 100 * case + 2 * k
            texts.append(" ".join([prose(seed, 39), f"x{seed}", *part, f"y{seed}", prose(seed + 1, 39)]))
    whole = {6 * case + k for case in range(12) for k in (4, 5)}
    for block in (substring_dedup.BLOCK, 2):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        monkeypatch.setattr(substring_dedup, "INSIDE", block if block == 2 else substring_dedup.INSIDE)
        monkeypatch.setattr(substring_dedup, "FEW", min(block, substring_dedup.FEW))
        found = [r for r in repeated_passages(documents(texts)).collect() if not r.kept]
        assert {r.doc_id for r in found} == whole
        assert all((r.start_word, r.end_word, r.first_doc_id) == (40, 94, r.doc_id // 6 * 6 + 3) for r in found)


def test_planted_near_copies_are_found(documents):
    """Passages of 50 to 200 words with up to five edits, where they are alike enough, between words of their own."""
    draw, texts, wanted = random.Random(21), [], {}
    for case in range(150):
        size, edits = draw.randint(50, 200), draw.randint(0, 5)
        passage = [f"w{case}x{k}" for k in range(size)]
        other = list(passage)
        for _ in range(edits):
            at = draw.randrange(len(other))
            kind = draw.choice(["swap", "drop", "add"])
            other[at : at + (kind != "add")] = [] if kind == "drop" else [f"e{case}x{draw.random()}"]
        sides = [[f"s{case}n{k}x{i}" for i in range(draw.randint(0, 60))] for k in range(4)]
        texts += [" ".join(sides[0] + passage + sides[1]), " ".join(sides[2] + other + sides[3])]
        ours, theirs = (set(zip(*(x[i:] for i in range(5)))) for x in (passage, other))
        if len(other) >= 50 and 4 * len(ours & theirs) >= 3 * len(ours | theirs):
            wanted[2 * case + 1] = (len(sides[2]), len(sides[2]) + len(other))
    found = {r.doc_id for r in repeated_passages(documents(texts)).collect() if not r.kept}
    assert len(wanted) > 100 and len(found & set(wanted)) >= 0.97 * len(wanted)


def test_every_repeated_run_is_covered(documents, monkeypatch):
    """Passages in random company, pieces of them, and crowded buckets: no window of 50 words that repeats is left out."""
    draw, pool = random.Random(4), [prose(i, 90).split() for i in range(6)]
    texts = []
    for i in range(90):
        words = [f"o{i}n{k}" for k in range(draw.randint(0, 30))]
        for passage in draw.sample(pool, draw.randint(1, 3)):
            start = draw.randint(0, 35)
            words += passage[start : start + draw.randint(45, 90)] + [f"m{i}n{k}" for k in range(draw.randint(0, 12))]
        texts.append(" ".join(words))
    first, repeats = {}, {}
    for i, text in enumerate(texts):
        words = text.split()
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), i) != i:
                repeats.setdefault(i, []).append(k)
    for crowded in (substring_dedup.CROWDED, 3):
        monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
        spans = {}
        for r in repeated_passages(documents(texts)).where("not kept").collect():
            spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        missed = [(i, k) for i, places in repeats.items() for k in places if not any(s <= k and k + 50 <= e for s, e in spans.get(i, []))]
        assert missed == [] and sum(map(len, repeats.values())) > 500


def test_partners_passed_over_are_asked_again(spark):
    """The third of three look-alikes is no foremost partner, and is met after all where nothing verified covers the window."""
    base, arounds = np.random.default_rng(3).integers(0, 4, 96).astype(np.uint8), []
    for changed in ([30, 60], [35, 55], [33, 58], []):
        codes = base.copy()
        codes[changed] ^= 1
        arounds.append((codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes())
    place = 200 << 24 | 100 << 12 | 100
    rows = [(8, doc, 7, place, around, None, None, None) for doc, around in enumerate(arounds, 1)]
    schema = substring_dedup.schema_of(substring_dedup.WINDOW)
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    met = [r for b in substring_dedup._in_buckets(iter([batch])) for r in b.to_pylist()]
    assert {(r["doc_a"], r["doc_id"]) for r in met if r["open"] == 0} == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4)}
    assert sorted((r["doc_id"], r["open"], r["left"], r["right"]) for r in met if r["open"] > 3) == [(1, 4, -1, -1), (2, 4, -1, -1), (3, 4, -1, -1), (4, 5, 45, 45)]
    pool = spark.createDataFrame([r[:5] for r in rows], substring_dedup.MEMBER)
    asking = spark.createDataFrame([(8, 4, 7, place, 45, 45)], "bucket long, doc_id long, mark int, place long, left int, right int")
    uids = {r.doc_id: r.uid for r in pool.selectExpr("doc_id", "xxhash64(doc_id, bigint(mark)) uid").collect()}
    for end, wanted in ((200, {(1, 4), (2, 4), (3, 4)}), (245, set())):
        found = spark.createDataFrame([(uids[1], uids[4], 150, end, 150, end)], substring_dedup.SPAN)
        pairs = {(r.a, r.b) for r in substring_dedup._passed_over(asking, pool, found).collect()}
        assert pairs == {(uids[x], uids[y]) for x, y in wanted}


def test_what_asks_again_meets_no_crowd(spark):
    """One word said again and again is no likeness; of many places two documents are held together once each, and only beyond what is covered."""
    draw, (schema, ddl) = np.random.default_rng(5), (substring_dedup.schema_of(substring_dedup.WINDOW), substring_dedup.MEMBER)
    packed = lambda codes: (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes()
    rows = []
    for doc in range(1, 41):
        codes = draw.integers(0, 4, 96).astype(np.uint8)
        codes[30:62] = 2
        rows.append((8, doc, 7, 200 << 24 | 100 << 12 | 100, packed(codes), None, None, None))
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    assert [r for b in substring_dedup._in_buckets(iter([batch])) for r in b.to_pylist()] == []

    base = draw.integers(0, 4, 96).astype(np.uint8)
    short = base.copy()
    short[:25] ^= 1
    short[66:] ^= 1
    asking = "bucket long, doc_id long, mark int, place long, left int, right int"
    place = lambda k: (200 + k) << 24 | 100 << 12 | 100
    uid = spark.range(1).selectExpr("xxhash64(2L, 7L) u").first().u
    for codes, end, wanted in ((base, 190, 3), (short, 190, 3), (base, 232, 3), (short, 232, 0)):
        pool = spark.createDataFrame([(8, doc, 7, place(k), packed(codes if doc == 1 else base)) for doc in (1, 2) for k in range(3)], ddl)
        asks = spark.createDataFrame([(8, 2, 7, place(k), 45, 45) for k in range(3)], asking)
        found = spark.createDataFrame([(5, uid, 100, end - 50, 150, end)], substring_dedup.SPAN)
        assert substring_dedup._passed_over(asks, pool, found).count() == wanted


def test_places_beyond_24_bits():
    centre = (1 << 24) + 70
    place = pa.array([centre << 24 | 50 << 12 | 50], pa.int64())
    columns = {"a": pa.array([1]), "b": pa.array([2]), "at_a": place, "at_b": place, "bucket": pa.array([0])}
    found = substring_dedup._meet(pa.table(columns))
    assert found is not None and (found["from_a"][0], found["to_a"][0]) == (centre - 50, centre + 50)
    assert "mark int" in substring_dedup.WINDOW


def test_repetitive_texts_that_part_too_often_are_not_searched(monkeypatch):
    """Each of two lines said a hundred times misses five of thirty shingles of the other: no stretch shares three in four."""
    searched, longest = [], substring_dedup._longest
    monkeypatch.setattr(substring_dedup, "_longest", lambda *x: searched.append(1) or longest(*x))
    line = np.arange(30, dtype=np.uint64)
    other = np.where(line < 5, line + np.uint64(100), line)
    assert passages(np.tile(line, 100), np.tile(other, 100), 46) == [] and len(searched) < 10
    assert passages(np.tile(line, 100), np.tile(np.where(line < 3, line + np.uint64(100), line), 100), 46) != []
    draw = np.random.default_rng(9)
    for _ in range(200):
        own, shared = draw.integers(0, 12, draw.integers(5, 60)), draw.random(12) < 0.6
        brute = [len(set(own[i : i + 7][~shared[own[i : i + 7]]].tolist())) for i in range(len(own) - 6)]
        assert substring_dedup._misses(own, shared[own], 7) == min(brute, default=0)


def test_stretches_too_far_apart_are_known_by_their_sums():
    """Where two stretches without repeats share three in four, both sums together are not below 0."""
    draw = np.random.default_rng(10)
    for _ in range(500):
        n, m, shared = *draw.integers(46, 80, 2), int(draw.integers(30, 60))
        shared = min(shared, n, m)
        sides = [draw.permutation(np.arange(size) < shared) for size in (n, m)]
        if 4 * shared >= 3 * (n + m - shared):
            assert sum(substring_dedup._best(x, 46) for x in sides) >= 0
    assert substring_dedup._best(np.ones(45, bool), 46) < -1000


def _found_windows(texts):
    """Windows of texts as a batch, sorted as tasks read them."""
    found = substring_dedup._of_texts([t.encode() for t in texts], 0, 46)
    bucket, row, place, around = map(np.concatenate, zip(*found))
    order = np.lexsort((place, row, bucket.view(np.int64)))
    schema = substring_dedup.schema_of(substring_dedup.WINDOW)
    columns = [bucket.view(np.int64)[order], row[order], np.full(len(row), 7), place[order], [x.tobytes() for x in around[order]]]
    arrays = [pa.array(x, f.type) for x, f in zip(columns, schema)] + [pa.nulls(len(row), schema.field(k).type) for k in (5, 6, 7)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def test_a_word_again_and_again_is_compared_from_its_first_place(monkeypatch):
    """Of a word said dozens of times a document has many windows in one bucket; one of them is compared with other documents'."""
    texts = [" ".join([prose(2 * i, 60), *["and"] * (30 + i), prose(2 * i + 1, 60)]) for i in range(12)]
    batch, compared, pairs = _found_windows(texts), [], substring_dedup._compared_pairs

    def counted(table, group, side, open_, first_rows=1 << 31):
        compared.append(np.stack((group, table.column("doc_id").to_numpy()), axis=1))
        return pairs(table, group, side, open_, first_rows)

    monkeypatch.setattr(substring_dedup, "_compared_pairs", counted)
    list(substring_dedup._in_buckets(iter([batch])))
    buckets = np.array(batch.column("bucket"))
    assert np.unique(buckets, return_counts=True)[1].max() > 24
    assert all(np.unique(rows, axis=0, return_counts=True)[1].max() == 1 for rows in compared)


def test_packed_windows_come_through(spark, documents):
    """Windows that share a bucket with another document's come through, sorted; the others do not."""
    shared = prose(50, 180)
    texts = [prose(i, 70) + " " + shared + " " + prose(100 + i, 50) for i in range(4)] + [prose(200, 300)]
    plain = _found_windows(texts).to_pylist()
    docs = {}
    for r in plain:
        docs.setdefault(r["bucket"], set()).add(r["doc_id"])
    wanted = sorted((r["bucket"], r["doc_id"], r["place"], r["around"]) for r in plain if len(docs[r["bucket"]]) > 1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in (1, 100):
            spark.conf.set(size, rows)
            packed = substring_dedup._windows(substring_dedup._keyed(documents(texts).coalesce(1)), 50).orderBy("part").toArrow()
            found = [r for b in substring_dedup._unpacked(iter(packed.to_batches())) for r in b.to_pylist()]
            own = [(r["bucket"], r["doc_id"], r["place"], r["around"]) for r in found if r["doc_a"] is None]
            links = [r for r in found if r["doc_a"] is not None]
            if rows == 1:  # each document is a batch, so that none is linked where it is read
                assert sorted(own) == wanted and links == []
            else:
                assert set(own) < set(wanted) and links and all(r["doc_a"] < r["doc_id"] for r in links)
    finally:
        spark.conf.set(size, before)


def test_pairs_of_documents_are_met_many_at_once():
    """Stretches of many pairs in one table are those of each pair alone, in any order of the rows."""
    draw, rows = np.random.default_rng(12), []
    for pair in range(40):
        for _ in range(int(draw.integers(1, 9))):
            at = [int(draw.integers(0, 400)) for _ in range(2)]
            if draw.random() < 0.5:
                at[1] = at[0] + 7 * (pair % 3)
            reach = [int(x) for x in draw.integers(10, 90, 4)]
            told = (-1, -1) if draw.random() < 0.4 else (int(draw.integers(0, 46)), int(draw.integers(0, 46)))
            rows.append((pair // 4, 100 + pair % 4, at[0] << 24 | reach[0] << 12 | reach[1], at[1] << 24 | reach[2] << 12 | reach[3], *told))
    names = ["a", "b", "at_a", "at_b", "left", "right"]

    def met(some):
        columns = dict(zip(names, (pa.array(x, pa.int64()) for x in zip(*some))))
        found = substring_dedup._meet(pa.table(columns))
        return sorted(zip(*(np.asarray(x).tolist() for x in found.values())))

    alone = sorted(r for k in range(40) for r in met([x for x in rows if x[:2] == (k // 4, 100 + k % 4)]))
    assert met(rows) == alone == met([rows[i] for i in draw.permutation(len(rows))]) and len(alone) > 40
