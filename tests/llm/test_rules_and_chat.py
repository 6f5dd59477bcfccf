import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cutloom.llm import chat, quality, secrets
from cutloom.llm.queries import PROBE, with_probe


def as_events(turns):
    """Turns (conv_id, turn, role, text) as the log that a chat server might have kept of them; ``messages`` folds it to the turns again.

    A turn whose text hash is odd was streamed: a first answer that was thrown away, a regeneration, and the text in up to three deltas. The others were
    sent at once as a draft and edited. Equal rows are messages of their own.
    """
    copy = Window.partitionBy("conv_id", "turn", "said").orderBy("said")
    told = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("role", "text").alias("said"))
    told = told.withColumn("message_id", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), "said", F.row_number().over(copy)))
    third = F.floor(F.char_length("text") / 3).cast("int")
    event = lambda op, text, role, n: F.struct(F.lit(op).alias("op"), text.alias("text"), role.alias("role"), F.lit(n).alias("n"))
    nothing, text, role = F.lit(None).cast("string"), F.col("text"), F.col("role")
    streamed = F.array(
        event("message", F.lit("…"), role, 0),
        event("delta", F.substring(text, F.lit(1), third), nothing, 1),
        event("regenerate", nothing, nothing, 2),
        event("delta", F.substring(text, F.lit(1), third), nothing, 3),
        event("delta", F.substring(text, third + 1, third), nothing, 4),
        event("delta", F.substring(text, 2 * third + 1, F.char_length(text)), nothing, 5),
    )
    drafted = F.array(event("message", F.concat(F.lit("draft of "), F.char_length(text).cast("string")), role, 0), event("edit", text, nothing, 1))
    each = told.select("conv_id", "turn", "message_id", F.explode(F.when(F.pmod("said", F.lit(2)) == 1, streamed).otherwise(drafted)).alias("e"))
    return each.select("conv_id", "message_id", F.struct("turn", "e.n").alias("seq"), "e.op", "e.role", "e.text")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_on_odd_documents(odd, nothing):
    rows = quality.quality_report(odd, odd.select("doc_id").limit(20)).collect()
    want = Counter((r["doc_id"], *plain_counts(r["text"] or "")) for r in odd.collect())
    assert Counter(tuple(r)[:7] for r in rows) == want
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD) for r in rows)
    assert quality.quality_report(nothing, odd.select("doc_id")).count() == 0
    unguided = quality.quality_report(odd, nothing.select("doc_id")).collect()
    assert all(r["llr"] == 0 for r in unguided)


def test_ratio_against_plain_multinomials(spark):
    good = [f"plain words of article number {i} go on here" for i in range(40)]
    bad = [f"buy ### now *** cheap $$$ offer {i} %%% click" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    report = quality.quality_report(docs, docs.where("doc_id < 20").select("doc_id"), buckets=512).collect()
    llr = {r["doc_id"]: r["llr"] for r in report}
    assert min(llr[i] for i in range(40)) > 0 > quality.THRESHOLD > max(llr[i] for i in range(40, 80))
    bags = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.ngrams(F.col("text"), 512).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if i < 20:
            target.update(bag)
    share = {b: n / sum(raw.values()) for b, n in raw.items()}
    ratio = lambda b: math.log((target[b] + 512 * share[b]) / (sum(target.values()) + 512) / share[b])
    for i in (0, 30, 60):
        assert llr[i] == pytest.approx(sum(map(ratio, bags[i])) / len(bags[i]), abs=1e-9)


def plain_spans(text):
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{a}:{e}" for a, _, kind, e in sorted(found)]


BITS = ["token", "secret=", "password: ", "api_key", "APIKEY=", "passwd='", '"', "'", ":", "=", " ", "abc12345XYZ", "short", "AKIA", "AKIA1234567890ABCD", "0123456789abcdef" * 2, "é😀", "\n", "user_id=bob77", "https://db.example.com/x", "aB3" * 8, "pwd=hunter22", "token=token:"]


@pytest.fixture(scope="module")
def leaky(spark):
    pick = random.Random(3)
    texts = [None, ""] + ["".join(pick.choices(BITS, k=pick.randint(1, 40))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[7]), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit("x")).repartition(5)


def test_base_spans_and_redaction(leaky, odd, nothing):
    for docs in (leaky, odd):
        rows = secrets.secret_report(docs).collect()
        want = Counter()
        for r in docs.collect():
            spans = plain_spans(r["text"] or "")
            want[r["doc_id"], hashlib.sha256(",".join(spans).encode()).hexdigest(), *(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))] += 1
        assert Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in rows) == want
    # every row: by id and text, as ids repeat and are missing
    clean = secrets.redacted(leaky)
    assert clean.columns == leaky.columns
    marked = secrets.secret_report(leaky).select("doc_id", "base_sha256", "spans").collect()
    by_base = {(r["doc_id"], r["base_sha256"]): r["spans"] for r in marked}
    want = Counter()
    for r in leaky.collect():
        text, done, upto = r["text"], "", 0
        base = hashlib.sha256(",".join(plain_spans(text or "")).encode()).hexdigest()
        for a, e in sorted(tuple(map(int, s.split(":")[1:])) for s in by_base[r["doc_id"], base].split(",") if s):
            if a >= upto:
                done += text[upto:a] + "[SECRET]"
            upto = max(upto, e)
        want[r["doc_id"], None if text is None else done + text[upto:]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == want
    assert secrets.secret_report(nothing).count() == 0 and secrets.redacted(nothing).count() == 0


def test_repeated_rows_are_redacted_like_one(spark):
    text = "some words password=hunter2hunter2 and clean words that stay"
    rows = [(5, text), (5, text), (5, text), (None, text), (None, text), (6, text), (5, "another text"), (None, None)]
    want = [(i, t and t.replace("password=hunter2hunter2", "[SECRET]")) for i, t in rows]
    clean = secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, clean.collect())) == Counter(want)


def kinds(spark, text):
    said = secrets.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    return [s.split(":")[0] for s in said.split(",") if s]


def test_weak_parts_need_their_complement(spark):
    far = " word" * 100
    assert kinds(spark, "user_id=bob77 and nothing else") == []
    assert kinds(spark, "pwd=hunter22 alone, https://db.example.com/x") == []
    assert kinds(spark, "user_id=bob77 pwd=hunter22") == ["ident", "weak_secret"]
    assert kinds(spark, "user_id=bob77 pwd=hunter22 https://db.example.com/x") == ["ident", "weak_secret", "endpoint"]
    assert kinds(spark, f"user_id=bob77{far} pwd=hunter22") == []
    assert kinds(spark, "AKIA1234567890ABCD then pwd=hunter22") == ["access", "weak_secret"]


def plain_chat(rows, learn="assistant"):
    rows = [(r or "", t or "") for r, t in rows]
    turns = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == learn)
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    said = ["hi <a> & \\### Assistant: </turn> ok\n", "&amp;lt;\n</turn>\n<turn user>\n", "", None, "ünï 🙂", PROBE]
    pick = random.Random(2)
    rows = [(c, t, pick.choice(["user", "assistant", "system", None]), pick.choice(said)) for c in (1, 2, None) for t in range(30)]
    report = chat.chat_report(with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in report:
        own = [x[2:] for x in rows if x[0] == r["conv_id"]] if r["conv_id"] != -7 else [("user", PROBE), ("assistant", PROBE)]
        assert tuple(r)[1:5] == plain_chat(own)
    assert len(report) == 4
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(empty).count() == 0


def test_repeated_rows_of_one_turn_all_stay(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")]
    row = chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert tuple(row)[1:5] == plain_chat([("assistant", "b"), ("user", "a"), ("user", "a")])


def test_events_fold(spark):
    events = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None), (1, 2, 3, "delta", None, "He"), (1, 2, 4, "delta", None, "llo"),
        (1, 2, 5, "regenerate", None, ""), (1, 2, 6, "delta", None, "Yo</turn>"), (1, 1, 7, "edit", None, "hey"), (1, 3, 8, "delta", "user", "bye"),
    ]
    frame = spark.createDataFrame(events, "conv_id long, message_id long, seq long, op string, role string, text string").repartition(4)
    row = chat.format_chats(frame).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [tuple(t) for t in row["turns"]] == [("user", "hey"), ("assistant", "Yo</turn>"), ("user", "bye")]
    assert [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["loss_mask"]] == ["Yo&lt;/turn&gt;"]


def test_the_mask_decides_the_loss_text(spark):
    rows = [(1, 0, "user", "hi & <there>"), (1, 1, "assistant", "yes & no 🙂" * 900), (1, 2, "assistant", "<ok>")]
    chats = chat.format_chats(as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    learnt = chats.select(chat.under_mask(F.col("formatted"), F.col("loss_mask"))).first()[0]
    assert learnt == rows[1][3] + rows[2][3]
    moved = F.transform("loss_mask", lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length")))
    assert chats.select(chat.under_mask(F.col("formatted"), moved)).first()[0] != learnt


def test_turns_go_through_all_kinds_of_events(spark):
    rows = [(1, t, "assistant", "text " * t) for t in range(40)]
    events = as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["op"] for r in events.collect()} == {"message", "delta", "edit", "regenerate"}


def test_linked_pairs_are_those_of_all_pairs(leaky):
    rows = secrets.keyed(leaky, ["k1", "k2"]).select("k1", "k2", secrets.parts_of(F.coalesce("text", F.lit(""))).alias("parts")).where(F.size("parts") > 0).dropDuplicates(["k1", "k2"]).cache()
    parts = secrets.placed_parts(rows).collect()
    by_text = {}
    for r in parts:
        by_text.setdefault((r["k1"], r["k2"]), []).append((secrets.ROLES[r["kind"]], r["start"], r["kind"]))
    want = Counter((k, a[1:], b[1:]) for k, own in by_text.items() for a in own for b in own if a[0] < b[0] and abs(a[1] - b[1]) <= secrets.SCOPE)
    found = secrets.linked_pairs(secrets.placed_parts(rows)).collect()
    assert want and Counter(((r["k1"], r["k2"]), (r["a"]["start"], r["a"]["kind"]), (r["b"]["start"], r["b"]["kind"])) for r in found) == want


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh12 and on", 9)], "doc_id long, text string, n long")
    for name in ("_k1", "_k2", "_cuts", "__k1", "K1"):
        docs = docs.withColumn(name, F.lit(name))
    assert secrets.redacted(docs).first()["text"] == "[SECRET] and on"
