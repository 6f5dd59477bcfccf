import hashlib

from pyspark.sql import functions as F

from cutloom.llm import fingerprint


def plain_signature_order(texts, spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprint.signature(F.col("t")).alias("s"))
    return [r["s"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_edited_texts_and_neighbours(odd, nothing):
    rows = fingerprint.fingerprint_report(odd).collect()
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert len(rows) == len(docs)
    # unique ids have one place in the order
    ids = [d for d, _ in docs]
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    seen = {r["doc_id"]: r for r in rows}
    checked = 0
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)]
        if ids.count(doc_id) == 1 and ids.count(after[0]) == 1:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[1][:half]
            assert seen[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert seen[doc_id]["n_chars"] == len(text)
            checked += 1
    assert checked > 30
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.fingerprint_report(nothing).count() == 0


def test_one_document_is_its_own_neighbour(spark):
    row = fingerprint.fingerprint_report(spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(("abcd efgh"[:5] + "abcd").encode()).hexdigest()


def test_equal_texts_and_edits(spark):
    long = " ".join(f"w{i}" for i in range(600))
    changed = long.replace("w300 ", "other ")
    other = " ".join(f"v{i}" for i in range(600))
    same, again, near, far, blank = plain_signature_order([long, long, changed, other, " \n"], spark)
    assert same == again and blank == []
    alike = lambda a, b: len(set(a) & set(b)) / len({x >> 32 for x in a} | {x >> 32 for x in b})
    assert alike(same, near) > 0.8 and alike(same, far) < 0.05


def test_order_and_repeats_count(spark):
    """A set of k-mers does not tell these apart; places and occurrence numbers do."""
    parts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    forward, backward, doubled = plain_signature_order([" ".join(parts), " ".join(reversed(parts)), " ".join(parts + parts)], spark)
    share = len(set(forward) & set(backward)) / len(forward)
    assert 0.1 < share < 0.8
    assert len(set(forward) & set(doubled)) / len(forward) < 0.8


def test_signature_matches_plain_selection(spark):
    """The two smallest numbered k-mers of a bin, numbered by occurrence, as plain code selects them."""
    text = " ".join(["a b c d e f"] * 30 + [f"w{i % 50}" for i in range(300)])
    pieces = text.split(" ")
    kmers = [tuple(pieces[i : i + 5]) for i in range(len(pieces) - 4)]
    seen, numbered = {}, []
    for k in kmers:
        numbered.append((k, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    rows = spark.createDataFrame([(i, *k, o) for i, (k, o) in enumerate(numbered)], "i int, a string, b string, c string, d string, e string, o int")
    hashed = rows.select(F.xxhash64(F.xxhash64("a", "b", "c", "d", "e"), "o").alias("h"), "i").collect()
    bins = {}
    for r in hashed:
        x = (r["h"] & ~((1 << 24) - 1)) | r["i"]
        bins.setdefault((x >> 58) & 63, []).append((x, r["i"]))
    tuples = {b: [x >> 24 & ((1 << 40) - 1) for x, _ in sorted(sorted(v)[:2], key=lambda p: p[1])] for b, v in bins.items()}
    want = set()
    for b, values in tuples.items():
        frame = spark.createDataFrame([tuple(values)], ", ".join(f"v{j} long" for j in range(len(values))))
        h = frame.select(F.xxhash64(*frame.columns)).first()[0]
        want.add((b << 32) | (h & 0xFFFFFFFF))
    assert set(plain_signature_order([text], spark)[0]) == want


def test_neighbours_of_far_and_crowded_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SLICE_ROWS", 4)
    ids = [-9 * 10**18, 9 * 10**18, 10**15, *range(60), *[7] * 50, *[None] * 20]
    texts = [f"text number {n} of row {i}" for i, n in enumerate(ids)]
    made = list(zip(ids, texts, strict=True)) + [(7, "equal rows")] * 5
    rows = spark.createDataFrame(made, "id long, t string").repartition(5)
    found = [(r["id"], r["t"], r["next"]["id"], r["next"]["t"]) for r in fingerprint.with_next(rows, ["id", "t"], by="t", key="id").collect()]
    assert sorted(map(str, made)) == sorted(str(x[:2]) for x in found)
    # every row is the next one of exactly one, and ids descend but where the ring closes
    assert sorted(str(x[2:]) for x in found) == sorted(map(str, made))
    key = lambda x: (x is not None, x or 0)
    rising = [x for x in found if key(x[2]) > key(x[0])]
    assert len(rising) == 1 and rising[0][0] is None and rising[0][2] == 9 * 10**18


def test_places_beyond_the_packed_bits(spark, monkeypatch):
    """A text with more k-mers than packed places gives what the same selection with places of their own gives."""
    text = " ".join(f"w{i % 700}" for i in range(2000))
    frame = spark.createDataFrame([(text,)], "t string")
    want = frame.select(fingerprint.signature(F.col("t"))).first()[0]
    numbers = fingerprint.Numbers
    monkeypatch.setattr(fingerprint, "Numbers", lambda wide=False: numbers(wide=True))
    assert frame.select(fingerprint.signature(F.col("t"))).first()[0] == want


def test_likeness_is_the_share_of_equal_parts(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(3, long), (2, long + " end"), (1, "short one"), (0, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs).collect()}
    parts = lambda x: {p[:-8]: p for p in x.split(".")} if x else {}

    def share(a, b):
        bins = set(parts(a)) | set(parts(b))
        return sum(parts(a).get(k) == parts(b).get(k) for k in bins) / len(bins) if bins else 1.0

    for i, r in rows.items():
        assert r["near_edited"] == share(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == share(r["fingerprint"], rows[(i - 1) % 4]["fingerprint"])
