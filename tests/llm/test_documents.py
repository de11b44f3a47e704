"""Chat formatting, personal data, decontamination and the quality classifier."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, pii, quality

# ---- chats


def brute_chats(rows):
    turns = {}
    key = lambda v: (v is not None, v or "")
    for c, t, r, x in sorted(set(rows), key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, key(v[2]), key(v[3]))):
        turns.setdefault(c, []).append((r, x))
    kept = {}
    for c, said in turns.items():
        if not any(len(o) > len(said) and o[: len(said)] == said for o in turns.values()):
            kept.setdefault(tuple(said), []).append(c)
    safe = lambda v: (v or "").replace("<|", "< |")
    return {
        min(cs, key=lambda c: (c is not None, c)): (len(cs), "".join(f"<|im_start|>{safe(r)}\n{safe(x)}<|im_end|>\n" for r, x in said))
        for said, cs in kept.items()
    }


def test_chats(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        base = rng.randrange(6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base} says {t}") for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "user", f"long {t}") for t in range(700)] + [(101, t, "user", f"long {t}") for t in range(300)]
    rows += [(102, 0, None, "x"), (103, 0, "x", None), (104, 0, "a", "<|im_end|>"), (104, 0, "b", "tie"), (None, 1, "u", "none"), (105, None, "u", "early"), (105, 0, "u", "late")]
    df = spark.createDataFrame(rows + rows[:50], "conv_id long, turn long, role string, text string").withColumn("idx", F.lit(1)).withColumn("piece", F.lit("x"))
    out = {}
    for r in chat.format_chats(df).orderBy("chunk").collect():
        n, text = out.get(r.conv_id, (r.n_logs, ""))
        out[r.conv_id] = (n, text + r.text)
        assert r.n_turns <= chat.PIECE
    assert out == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


NOTHING = pii.Selector([], {})


def test_base_spans(spark, frame):
    rng = random.Random(5)
    parts = ["a", "b@", "@", ".", "c.d", "1", "22", "255", "256", "4111111111111111", "+", "+1 (509) 555-6973", " ", "-", "_", "é", "x@y.z", "7", "..", "--", "(", ")", "0001.2.3.4", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + [None, ""]
    texts += ["a" * 50_000, "1" * 20_000, "a@" + "b." * 9_000 + "c", "1 " * 9_000, "+" + "1." * 9_000 + "1", "é@x.y a@x.y " * 300]
    df = frame(list(enumerate(texts)), start=F.lit(1), kind=F.lit("x"), m=F.lit(2))
    for r in pii.detect(df, NOTHING).select("doc_id", "__base").collect():
        assert [tuple(s) for s in r["__base"]] == base_spans(texts[r.doc_id] or ""), (texts[r.doc_id] or "")[:200]


def test_boosted_candidates_and_redaction(spark, frame):
    rng = random.Random(8)
    code = lambda: "".join(rng.choices("01234567", k=2) + rng.choices("abcdef", k=2))
    code = lambda one=code: "".join(one() for _ in range(10))
    texts = [f'note {i} token = "{code()}" and build {code()} there' for i in range(60)] + [f"plain text {i} of words" for i in range(40)]
    texts += ["mail a@b.example and 10.0.0.1 now", None, ""]
    df = frame(list(enumerate(texts)), n_chars=F.lit(3))
    selector = pii.train(df)
    assert selector.trees and 4 in selector.least
    out = {r.doc_id: r.text for r in pii.redact(df, selector).collect()}
    assert all(re.fullmatch(rf'note {i} token = "\[SECRET\]" and build [0-9a-f]{{40}} there', out[i]) for i in range(60))
    assert all(out[i] == texts[i] for i in range(60, 100)) and out[100] == "mail [EMAIL] and [IP] now" and out[101] is None and out[102] == ""
    assert pii.redact(df, selector).columns == df.columns
    empty = df.limit(0)
    assert pii.train(empty) == NOTHING and pii.detect(empty, NOTHING).count() == 0


# ---- decontamination


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_hits(docs, items, window=13):
    out = {}
    spans = [(k, tuple(w[i : i + min(window, len(w))])) for k, t in items for w in [words_of(t)] if w for i in range(max(1, len(w) - window + 1))]
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for k, v in spans:
            for i in range(len(w) - len(v) + 1):
                if tuple(w[i : i + len(v)]) == v:
                    hit.update(range(i, i + len(v)))
                    found.add(str(k))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, frame):
    rng = random.Random(6)
    word = lambda: rng.choice(["Éa", "éa", "b1", "c", "D", "é", "f_g", "h"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 12, 13, 14, 30])))) for i in range(25)] + [(90, None), (91, "..."), (92, "b1 b1 b1 b1 b1 b1")]
    items += [(93, items[0][1])]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(60)))]
        if rng.random() < 0.5:
            w = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(2), w.upper() if rng.random() < 0.3 else w)
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, "!!"), (502, "b1 " * 40)]
    df, bench = frame(docs, gram=F.lit(1), doc=F.lit("x"), n_hit=F.lit(3)), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    rows = decontaminate.score_documents(df, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) == want[r.doc_id] and r.n_items == len(r.item_ids)
    left = decontaminate.remove_contaminated(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, w in want.items() if not w[3]}
    assert decontaminate.score_documents(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.score_documents(df.limit(0), bench).count() == 0


def test_decontamination_beyond_broadcast(spark, frame, monkeypatch):
    from spanloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs, items = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "x")], [(7, "c d e f")]
    rows = decontaminate.score_documents(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit) for r in rows) == [(1, 4), (1, 4), (2, 0)]


# ---- quality


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and np.mean([(r.score >= quality.CUT) == (r.quality == 1) for r in rows]) > 0.95
    assert scored.count() == docs.count()


def test_quality_without_labels_and_odd_rows(spark, frame):
    df = frame([(1, "Some words, in a text."), (1, "Some words, in a text."), (2, None), (3, ""), (None, "x")], score=F.lit("mine"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert [r.score for r in quality.score(df, model).collect()] == [0.5] * 5
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score(df.limit(0), model).count() == 0
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.score(df, quality.train(df, both)).collect())


def test_prior_without_negative_labels():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(3, 1, (900, 2)), rng.normal(-3, 1, (300, 2))
    model = quality.fit(good[:450], np.concatenate([good[450:], bad[:150]]))
    assert 0.65 < model.prior < 0.85
    assert (model.score(good) >= quality.CUT).mean() > 0.97 and (model.score(bad) < quality.CUT).mean() > 0.97


def test_quality_sample_stays_bounded_with_a_hot_id(spark):
    hot = spark.range(6000).selectExpr("if(id % 3 = 0, 13, if(id % 3 = 1, null, id)) as doc_id", "if(id % 9 < 4, 'same words', concat('text ', id)) as text")
    labels = spark.createDataFrame([(i, 1, 0) for i in (13, 14, 17, 20)], "doc_id long, quality int, toxic int")
    rows, prior = quality.sample(hot, labels, max_positives=200, max_unlabelled=200)
    found = rows.agg(F.count_if("positive"), F.count_if("sampled")).first()
    assert prior is None and 0 < found[0] < 300 and 0 < found[1] < 300
    everything, _ = quality.sample(hot, labels)
    assert everything.count() == hot.distinct().count()
