"""Each operator against a brute-force version or a round trip, with nulls, blanks, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeline.llm import chat_format, components, decontaminate, embed_dedup, lang_id, license_scan, lm_score, mixing, quality, queries, simhash, token_output
from lodeline.llm.common import hash_spans, remainder, same_spans, sorted_groups, spans, utf8, words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOC + ", fp string, score string, label string, tile int, size string, tokens string, _turn int"


def docs(spark, texts, kind=DOC):
    more = len(kind.split(",")) - 5
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), *[None] * more) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, kind)


def random_texts(n, seed=1, words=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(n)]


ODD = [None, "", " \n\t ", "x", "x", "A b", "é ü 漢字\x0bend", "w " * 30000]


def test_bytes_and_words():
    texts = ["a b", None, "", " cd  e\x0b\x0cf ", "é漢 x"]
    buf, offsets = utf8(pa.array(texts).slice(0))
    starts, ends, counts = words_of(buf, offsets)
    assert counts.tolist() == [2, 0, 0, 3, 2]
    assert [bytes(buf[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "b", "cd", "e", "f", "é漢", "x"]
    h = hash_spans(buf, starts, ends)
    assert len(set(h.tolist())) == 7 and h[0] == hash_spans(np.frombuffer(b"zz a", np.uint8), np.array([3]), np.array([4]))[0]
    assert list(spans(np.array([0, 5, 50, 51]), 10)) == [(0, 1), (1, 2), (2, 3)]


def thue_morse(doublings=10):
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_stretches_apart():
    rng = np.random.default_rng(4)
    texts = list({bytes(rng.integers(97, 100, rng.integers(1, 40), dtype=np.uint8)) for _ in range(100_000)})
    texts += [w.encode() for n in (4, 6, 8, 9, 10, 12) for w in thue_morse(n)] + [b"a" * n for n in range(500, 530)]
    texts = sorted(set(texts))
    buf, offsets = utf8(pa.array([t.decode() for t in texts]))
    h = hash_spans(buf, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == len(texts)
    turned = np.roll(np.arange(len(texts)), 1)
    assert same_spans(buf, offsets[:-1], offsets[1:], buf, offsets[:-1], offsets[1:]).all()
    assert not same_spans(buf, offsets[:-1], offsets[1:], buf, offsets[:-1][turned], offsets[1:][turned]).any()


def test_sorted_groups():
    keys = [1, 1, 1, 2, 2, 3, 3, 3, 3, 4, None, None]
    for sizes in ([12], [1] * 12, [3, 2, 4, 3], [2, 5, 0, 5]):
        batches, at = [], 0
        for n in sizes:
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(range(at, at + n))], ["k", "v"]))
            at += n
        groups = [g.column("v").to_pylist() for g in sorted_groups(iter(batches), ["k"])]
        assert sum(groups, []) == list(range(12)) and groups[:4] == [[0, 1, 2], [3, 4], [5, 6, 7, 8], [9]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = dict(map(tuple, components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def passage(seed, n=30):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n))


def test_decontamination(spark):
    item = f"{passage(1, 12)} has 3 km and 7.5 kg , Anna gave 3 km to {passage(2, 12)}"
    other = item.replace("3 km", "48 km").replace("7.5", "9,25").replace("Anna", "Berta")
    mixed = item.replace("has 3 km", "has 4 km")
    texts = [f"start {item.upper() if False else item} end", f"so it goes {other} on", f"here {mixed} there", passage(9, 60), None, "", item[: len(item) // 3], f"{item} {item}", "short one item"]
    bench = spark.createDataFrame([(7, item, "z"), (7, item, "z"), (8, None, "z"), (9, "two words", "z"), (10, "short one item", "z")], "item_id long, text string, tokens string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, texts, EXTRA), bench).collect()}
    assert {(0, 7), (1, 7), (7, 7), (8, 10)} <= set(found) and not {d for d, _ in found} & {3, 4, 5}
    assert found[1, 7]["reparameterised"] and not found[0, 7]["reparameterised"]
    assert found[2, 7]["coverage"] < found[0, 7]["coverage"]
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    texts = random_texts(60, 5)
    items = [(i, " ".join(texts[i].split()[:25])) for i in range(0, 40, 5)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), coverage=1.0).collect()}
    want = {(d, i) for i, t in items for d, x in enumerate(texts) if (f" {t} " in f" {x} " if len(t.split()) >= 3 else x == t)}
    assert got == want


def held(spark, text, item):
    rows = decontaminate.leaks(docs(spark, text if isinstance(text, list) else [text]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    return {r["doc_id"]: r for r in rows}


def test_decontamination_of_number_heavy_items(spark):
    for item in ("what is 12 + 34 + 56?", "compute 12 + 34 * 5 - 7.", "solve: 3, 5, 8, 13, 21, 34, what comes next?"):
        assert set(held(spark, [f"then {item} they asked", "then nothing of it"], item)) == {0}
    copy = held(spark, "then solve: 4, 6, 9, 14, 22, 35, what comes next? they asked", item)
    assert copy[0]["reparameterised"]


def test_decontamination_with_colliding_values(spark):
    item = f"{passage(11, 9)} buys 7 apples {passage(12, 9)} gives 5 pears {passage(13, 9)}"
    assert held(spark, "so " + item.replace(" 7 ", " 9 ").replace(" 5 ", " 9 "), item)[0]["coverage"] == 1
    same = item.replace(" 5 ", " 7 ")
    assert held(spark, "so " + same.replace("7 apples", "8 apples").replace("7 pears", "9 pears"), same)[0]["coverage"] == 1
    assert 0.3 <= held(spark, "so " + same.replace("7 pears", "9 pears"), same)[0]["coverage"] < 1


def test_decontamination_of_quoted_items(spark):
    item = "What is the capital of France?"
    found = held(spark, [f"as they asked {item}", item, f"They asked. {item}"], item)
    assert {d: r["reparameterised"] for d, r in found.items()} == {0: False, 1: False, 2: False}


def test_decontamination_of_changed_names_and_short_items(spark):
    item = "Anna has 3 apples in the old basket. Anna buys 4 pears at the little shop. How many does Anna have now, if Otto took 2 km of them?"
    changed = [
        item.replace("Anna", "Berta").replace("3", "7").replace("4", "12").replace("2 km", "9 mi"),
        item.replace("Anna", "Mary Ann").replace("Otto", "Hans Peter"),
        item.replace("3 apples", "three apples").replace("4 pears", "twenty-five pears"),
    ]
    texts = [f"{t} and then." for t in changed] + [item.lower(), f"so {item}", "Anna has an old basket. Otto buys pears."]
    found = held(spark, texts, item)
    assert set(found) == {0, 1, 2, 3, 4} and all(found[d]["coverage"] == 1 for d in (0, 1, 3, 4))
    assert found[2]["coverage"] >= 0.9 and all(found[d]["reparameterised"] for d in (0, 1, 2)) and not found[4]["reparameterised"]
    assert set(held(spark, ["forty two", "Forty two!", "he said forty two", "42", "forty three", None, "w " * 30000], "forty two")) == {0}
    null = docs(spark, [item]).withColumn("doc_id", F.lit(None).cast("long"))
    assert decontaminate.leaks(null, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_decontamination_of_generated_questions(spark):
    """Every re-parameterised copy is found, and no other question made from other words."""
    rng = random.Random(61)
    names = ["Anna", "Berta", "Otto", "Mia", "Jonas", "Lea Marie"]

    def fill(words):
        out = []
        for i, w in enumerate(words):
            out.append(rng.choice(names) if i % 9 == 2 else f"{rng.randint(2, 900)} {rng.choice(['kg', 'km', 'days'])}" if i % 7 == 5 else w)
        return " ".join(out)

    plain = [passage(1000 + k, rng.randint(14, 40)).split() for k in range(40)]
    items = [(k, fill(p)) for k, p in enumerate(plain)]
    other = dict(zip(names, [*names[1:], names[0]]))
    change = lambda t: re.sub("|".join(names), lambda m: other[m[0]], re.sub(r"\d+", lambda m: str(int(m[0]) + 1000), t))
    texts = [f"{passage(2000 + k, 20)} {change(t)} {passage(3000 + k, 20)}" for k, t in items] + [fill(passage(4000 + k, 60).split()) for k in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(40)}


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    item = passage(4)
    assert [tuple(r) for r in decontaminate.leaks(docs(spark, [f"a {item} b"]), spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "item_id").collect()] == [(0, 1)]


# 2


def test_licenses(spark):
    rng = random.Random(2)
    filler = random_texts(40, 8)
    texts, want = [], set()
    for i, f in enumerate(filler):
        name, text = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        words = f.split()
        at = rng.randint(0, len(words))
        texts.append(" ".join(words[:at] + [text if i % 2 else text.upper()] + words[at:]))
        want.add((i, name))
    texts += [None, "", "the license of this is unclear", "w " * 30000]
    got = {(r["doc_id"], r["license_id"]) for r in license_scan.scan(spark, docs(spark, texts + [texts[0]], EXTRA)).collect()}
    assert want <= got
    split = {n: license_scan.words_of(t) for n, t in license_scan.TEMPLATES}
    for d, name in got - want:  # templates that hold each other's words
        words = license_scan.words_of((texts + [texts[0]])[d])
        grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        t = split[name]
        k = min(5, len(t))
        assert len(grams(t, k) & grams(words, k)) >= 0.8 * len(grams(t, k))
    assert not {d for d, _ in got} & {40, 41, 42, 43}
    assert license_scan.scan(spark, docs(spark, [])).count() == 0


def test_licenses_against_brute_force(spark):
    """Templates with some words changed, so that containments lie on both sides of the threshold."""
    rng = random.Random(19)
    split = {n: license_scan.words_of(t) for n, t in license_scan.TEMPLATES}
    texts = []
    for k in range(150):
        name, t = rng.choice(list(split.items()))
        t = list(t)
        for at in rng.sample(range(len(t)), min(len(t), rng.choice([0, 0, 1, 1, 2, 4]))):
            t[at] = rng.choice(["thing", "work", "the", t[at - 1]])
        texts.append(" ".join([*random_texts(1, k)[0].split(), *t, *random_texts(1, 500 + k)[0].split()]))
    want = {}
    for d, text in enumerate(texts):
        words = license_scan.words_of(text)
        for name, t in split.items():
            size, k = max(8, 1 << (len(t) - 1).bit_length()), min(5, len(t))
            grams = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}  # noqa: E731, B023
            shares = [(len(grams(t) & grams(words[a : a + 2 * size])) / len(grams(t)), a) for a in range(0, len(words), size)]
            held = [(s, a) for s, a in shares if s >= 0.8]
            if held:
                want[d, name] = (pytest.approx(max(held)[0]), min(a for _, a in held), len(held))
    got = {(r["doc_id"], r["license_id"]): (r["containment"], r["first_word"], r["windows"]) for r in license_scan.scan(spark, docs(spark, texts)).collect()}
    assert got == want and 60 < len(want)
    assert len({d for d, _ in want}) < 150


def test_license_bands_hold_their_promise():
    for _, text in license_scan.TEMPLATES:
        n = len(license_scan.words_of(text))
        size = max(8, 1 << (n - 1).bit_length())
        m = max(1, n - 4)
        held = math.ceil(0.8 * m)
        assert 1 - (1 - held / (2 * size + m - held)) ** license_scan.bands_for(n, size) >= license_scan.RETRIEVED


# 3


def test_lm_score(spark):
    texts = random_texts(150, 4, words=150) + ODD + ["Common Words"]
    table = docs(spark, texts, EXTRA).withColumn("held_out", remainder("doc_id", 7) == 2)
    got = {r["doc_id"]: r for r in lm_score.score(spark, table).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in c for w in t), n, held[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_lm_learns(spark):
    """Held-out texts of a word order that counts can't know: the model must be well ahead of the base."""
    rng = random.Random(9)
    after = {w: [rng.randrange(300) for _ in range(3)] for w in range(300)}
    texts = []
    for _ in range(600):
        w, out = rng.randrange(300), []
        for _ in range(120):
            out.append(f"w{w}x")
            w = rng.choice(after[w])
        texts.append(" ".join(out))
    rows = lm_score.score(spark, docs(spark, texts).withColumn("held_out", remainder("doc_id", 7) == 2)).where("held_out").collect()
    assert all(r["score"] > r["base_score"] for r in rows)
    assert sum(r["score"] for r in rows) > 0.8 * sum(r["base_score"] for r in rows)


def test_segment_sums():
    rng = np.random.default_rng(2)
    for n in (1, 31, 32, 33, 500):
        x, ids = rng.normal(size=(n, 7)).astype(np.float32), np.sort(rng.integers(0, 9, n))
        fresh = np.append(True, ids[1:] != ids[:-1])
        assert np.allclose(lm_score._segment_sums(x, fresh), np.add.reduceat(x, np.flatnonzero(fresh), axis=0), atol=1e-4)


def test_segment_sums_of_long_stretches_in_an_order():
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(3000, 5)).astype(np.float32), np.sort(np.minimum(rng.pareto(0.5, 9000).astype(int), 400))
    fresh, order = np.append(True, ids[1:] != ids[:-1]), rng.integers(0, len(x), len(ids))
    assert np.bincount(ids).max() > lm_score.PACK**2
    want = np.add.reduceat(x[order].astype(np.float64), np.flatnonzero(fresh), axis=0)
    assert np.allclose(lm_score._segment_sums(x, fresh, order), want, atol=1e-3)


def test_segment_sums_cost_a_few_passes_over_the_rows():
    """A training step's gradient is the costliest part of op3: it mustn't take many times as long as reading its rows once."""
    rng = np.random.default_rng(4)
    n = 5 * lm_score.TRAIN_STEP
    x, ids = rng.normal(size=(n, lm_score.CLASSES)).astype(np.float32), np.sort(np.minimum(rng.pareto(0.4, n).astype(int), 7000))
    fresh, order, spare = np.append(True, ids[1:] != ids[:-1]), rng.permutation(n), np.empty_like(x)

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    taken = [(seconds(lambda: lm_score._segment_sums(x, fresh)), seconds(lambda: x.take(order, axis=0, out=spare, mode="clip"))) for _ in range(15)]
    assert min(a for a, _ in taken) < 2.5 * min(b for _, b in taken)


def test_lm_log_softmax_of_far_logits():
    rng = np.random.default_rng(5)
    for far in (1, 59, 61, 200, 1e4):
        small = (rng.uniform(-1, 1, (1300, 96)) * far).astype(np.float32)
        small[0], y = -far, rng.integers(0, 96, 1300)
        z = small.astype(np.float64)
        want = z[np.arange(1300), y] - z.max(axis=1) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
        assert np.allclose(lm_score._log_softmax_at(small, y), want, rtol=1e-5, atol=1e-4)


def test_lm_table_holds_the_most_frequent_words(spark, monkeypatch):
    counts = [(i, 1 + (i * i) % 997, i % 64) for i in range(400)]
    table = spark.createDataFrame(counts, "h long, c long, cls int")
    for most in (1000, 100, 1):
        monkeypatch.setattr(lm_score, "TABLE", most)
        v = lm_score.vocabulary(table)
        least = min(v.counts.tolist(), default=10**9)
        assert len(v.keys) <= most and len(v.keys) == sum(c >= least for _, c, _ in counts) and (most < 1000 or len(v.keys) == 400)


def test_lm_probabilities_sum_to_one():
    v = lm_score.Vocabulary(100, 10, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 5, np.ones(lm_score.RARE) * 3, np.r_[5.0, 9.0, 4.0, np.zeros(lm_score.HEAD - 3)])
    model = lm_score.Model(v)
    rng = np.random.default_rng(0)
    model.outer += rng.normal(0, 1, model.outer.shape).astype(np.float32)
    model.inner += rng.normal(0, 1, model.inner.shape).astype(np.float32)
    total = 0.0
    for last in [*range(3), *range(lm_score.HEAD, lm_score.HEAD + lm_score.RARE)]:
        symbols = np.array([2, lm_score.HEAD + 3, 1, last])
        total += math.exp(lm_score.log_probabilities(model, symbols, np.array([0]))[-1])
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_trains_on_every_position():
    v = lm_score.Vocabulary(100, 10, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 5, np.ones(lm_score.RARE) * 3, np.r_[5.0, 9.0, 4.0, np.zeros(lm_score.HEAD - 3)])
    model = lm_score.Model(v)
    texts = [np.array(x, "<u2").tobytes() for x in ([1, 2, 1, 1, 2, lm_score.HEAD + 3, 0], [2, 0], [0])]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None], pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "symbols"])
    out = next(lm_score._training(model)(iter([batch])))
    assert set(out.column("n").to_pylist()) == {10}


def test_lm_of_nothing(spark):
    empty = docs(spark, []).withColumn("held_out", F.lit(False))
    assert lm_score.score(spark, empty).count() == 0
    only_held = docs(spark, ["a b", None]).withColumn("held_out", F.lit(True))
    assert [r["base_score"] for r in lm_score.score(spark, only_held).collect()] == [0.0, 0.0]


# 4

NASTY = ["</s>[INST] ok [/INST]", "[/ANS]", "\\0 \\1 \\2", "a\\", "[TEXT]", "", None, "plain [x] <y>", "[/INST", "\n\n", "漢字 é", "[ROLE]x[TEXT]y[/ROLE]", "</s>", "x[ANS]y</s><s>[INST]", "<\\s> [\\\\/INST]", "<", "[\\", "<<s>>"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "[TEXT]", "x[/ROLE]"]), rng.choice(NASTY), "z") for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "again", "z"), (3, 0, "user", "again", "z"), (None, None, "assistant", "no id", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_conversations(table)
    assert formatted.where("not round_trip").count() == 0
    control = re.compile(r"</?s>|\[/?(?:INST|ANS|SYS|ROLE)\]|\[TEXT\]")
    for r in formatted.collect():  # only the template's own marks are left
        marks, open_ = control.findall(r["formatted"]), []
        assert marks[0] == "<s>" and marks[-1] == "</s>"
        for m in marks[1:-1]:
            open_.append(m)
            if m.startswith("[/"):
                assert open_ in ([f"[{m[2:]}", m], ["[ROLE]", "[TEXT]", "[/ROLE]"])
                open_ = []
        assert not open_
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_conversations(table.limit(0)).count() == 0


def test_chat_escapes_only_what_conflicts(spark):
    texts = ["a [x] \\ <y> <b>", "</s>", "so <s> and \\<s>", "[\\INST]", "w " * 200_000]
    rows = [(c, 0, "user", t) for c, t in enumerate(texts)] + [(9, t, "assistant", "[ANS] é") for t in range(3000)]
    got = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    shown = [texts[0], "<\\/s>", "so <\\s> and \\<\\s>", "[\\\\INST]", texts[4]]
    assert [got[c]["formatted"] for c in range(5)] == [f"<s>[INST]{t}[/INST]</s>" for t in shown]
    assert [got[c]["escaped"] for c in range(5)] == [False, True, True, True, False] and all(r["round_trip"] for r in got.values())
    spans_ = got[9]["loss_spans"]
    assert len(spans_) == 3000 and {got[9]["formatted"][a - 1 : a - 1 + n] for a, n in spans_} == {"[\\ANS] é"}


# 5


def languages(n=120):
    rng = random.Random(7)
    parts = {"aa": ["tho", "er", "ing", "wh"], "bb": ["eau", "é", "oui", "le"], "cc": ["sch", "ung", "ü", "ge"]}
    return [(i, " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 150))), k) for i, (k, p) in enumerate(list(parts.items()) * (n // 3))]


def test_language_id(spark):
    rows = languages() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1004, "½ ² Ⅷ _ 12", "aa"), (1003, "tho " * 30000, None), (1003, "tho " * 30000, None)]
    table = spark.createDataFrame([(*r, "z", 0.1) for r in rows], "doc_id long, text string, lang string, lang_pred string, extra double")
    model = lang_id.train(table.where(remainder("doc_id", 3) != 1))
    got = lang_id.predict(spark, table, model).collect()
    right = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(right) / len(right) >= 0.95 and len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got}
    assert by[1000] == by[1001] == by[1002] == by[1004] == ("und", 0.0) and by[1003][0] == "aa" and 0 <= by[1003][1] <= 1
    assert lang_id.train(table.limit(0)) is None
    assert {r["lang_pred"] for r in lang_id.predict(spark, table, None).collect()} == {"und"}


def test_language_network_sees_all_bytes():
    """Two scripts that differ in lead bytes only, and pooled responses against a plain convolution."""
    rng = np.random.default_rng(1)
    texts = ["".join(chr(b + rng.integers(0, 24)) for _ in range(100)) for b in (0x3B1, 0x430, 0x5D0, 0x4E00) for _ in range(40)]
    x, owner = lang_id.windows(*utf8(pa.array(texts)))
    model = lang_id.fit(x, (owner // 40), list("abcd"), epochs=4)
    best, sure = model.predict(*utf8(pa.array(texts)))
    assert (best == np.arange(160) // 40).mean() > 0.98 and (sure <= 1).all()
    plain = []
    for w in lang_id.WIDTHS:
        t = model.params[f"f{w}"]
        r = np.stack([sum(t[j][x[:, i + j]] for j in range(w)) for i in range(lang_id.WINDOW - w + 1)], axis=1)
        plain.append(np.maximum(r.max(axis=1) + model.params[f"b{w}"], 0))
    assert np.allclose(model.pooled(x), np.concatenate(plain, axis=1), atol=1e-4)


# 6


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(300):
        noise = 0.3 if i % 3 else 0.02
        rows.append((i, (centres[i % 40] + noise * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 4)))
    rows += [(300 + k, rows[0][1], 0) for k in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [float("inf")] + [1.0] * 15, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(spark, spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, v string")).collect()}
    ok = [(i, np.array(e, np.float64), lab) for i, e, lab in rows if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i, _, _ in rows}
    for i, a, la in ok:
        for j, b, lb in ok:
            if i < j and la == lb and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    want = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(links[i]), min(seen))
    assert got == want
    assert embed_dedup.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_in_a_crowd(spark):
    """One label with a hundred times the window's rows around one direction, most pairs just below the threshold, and planted links."""
    rng = np.random.default_rng(8)
    n, d = 5000, 48
    centre = rng.normal(size=d)
    centre /= np.linalg.norm(centre)

    def around(cosine):
        side = rng.normal(size=(n, d))
        side -= (side @ centre)[:, None] * centre
        side /= np.linalg.norm(side, axis=1)[:, None]
        return math.sqrt(cosine) * centre + math.sqrt(1 - cosine) * side  # pairs have about this cosine

    for cosine, least in ((0.7, 0.999), (0.9, 0.99), (0.96, 0.97)):
        x = around(cosine)
        for k in range(300):
            step = rng.normal(size=d)
            step -= (step @ x[k]) * x[k]
            x[n - 1 - k] = 0.981 * x[k] + math.sqrt(1 - 0.981**2) * step / np.linalg.norm(step)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.98
        want = near.sum(axis=1) - 1
        rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
        got = embed_dedup.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().sort_values("vec_id")
        assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= least * want.sum()


# 7


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ODD + random_texts(120, 12) + ["  two  spaces ", "\n\n x", "a b 　c", "don't 'll", " "]
    table = docs(spark, texts, EXTRA)
    folder, index = token_output.write_tokens(spark, table, path, length=64, rows=4)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(folder, index).collect()}
    start, want, stream = 0, {}, []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    assert got == want
    local = folder.removeprefix("file:").replace("//", "/")
    read = []
    import glob

    for name in sorted(glob.glob(f"{local}/*.arrows")):
        file = token_output.SequenceFile(name)
        for k in range(len(file)):
            ids, mask = file[k]
            assert len(ids) == len(mask) == 64
            read += ids[np.array(mask.to_pylist())].tolist()
    assert read == stream
    folder, index = token_output.write_tokens(spark, table.limit(0), path)
    assert token_output.read_tokens(folder, index).count() == 0


def test_piece_encoder_is_exact():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, encoder = Tokenizer.from_file(path), token_output.PieceEncoder(path)
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", " \n", "a", "The", "é", "1", "!", "'s", "<|endoftext|>", "　", " ", "漢", "\t", "\x1f", "\u0085", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, counts = encoder.encode(*utf8(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_piece_encoder_needs_little_memory():
    """One long text, and many texts with ever new words, need no more than a block and the memory of pieces."""
    import tracemalloc

    from lodeline.llm.common import spans
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, rng = Tokenizer.from_file(path), np.random.default_rng(4)

    def text(n, kinds):
        return " ".join(f"w{k:x}" for k in rng.integers(0, kinds, n).tolist())

    short = [text(400, 1 << 40) for _ in range(1200)]
    long = text(800_000, 20_000) + "\n" + "x" * 100_000 + " \t  end"
    for texts in ([long, "", "a b"], short):
        encoder = token_output.PieceEncoder(path)
        buf, offsets = utf8(pa.array(texts))
        got = []
        tracemalloc.start()
        for i, j in spans(offsets, token_output.CHUNK):
            ids, counts = encoder.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            got += zip(counts.tolist(), [zlib.crc32(x.tobytes()) for x in np.split(ids, np.cumsum(counts)[:-1])])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = [np.array(x.ids, encoder.kind) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert got == [(len(x), zlib.crc32(x.tobytes())) for x in want]
        assert peak < 100e6, f"{peak / 1e6:.0f} MB"


def test_pieces_that_hashes_confuse(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [f"x {thue_morse()[k]} y" for k in (0, 1)] + ["ab cd", "", "xy ef"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def check():
        encoder = token_output.PieceEncoder(path)
        for part in ([0], [1, 2], [3, 4], [0, 1, 2, 3, 4]):
            ids, counts = encoder.encode(*utf8(pa.array([texts[k] for k in part])))
            assert ids.tolist() == sum((want[k] for k in part), []) and counts.tolist() == [len(want[k]) for k in part]

    check()
    monkeypatch.setattr(token_output, "hash_spans", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    check()


# 8


def brute_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 3])
def test_simhash(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(simhash, "BLOCK", 4 if tile_rows == 3 else 2048)
    base = random_texts(50, 21)
    long = " ".join(random_texts(30, 22))
    near = [long + f" {k}" for k in range(12)]
    texts = base + base[:20] + near + ODD[:-1] + [b.upper() for b in base[:5]]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(spark, docs(spark, texts, EXTRA)).collect()}
    prints = [brute_simhash(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: (f"{p:016x}", find(i)) for i, p in enumerate(prints)}
    assert simhash.simhash_groups(spark, docs(spark, [])).count() == 0


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 3])
def test_wide_near_groups(spark, monkeypatch, tile_rows):
    """Copies of 0.9 or more share a class, texts below 0.6 never do, unless chained; ids may be null or repeated."""
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(simhash, "BLOCK", 4 if tile_rows == 3 else 2048)
    rng = random.Random(15)
    pool = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(60):
        base = [rng.choice(pool) for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 3, 25):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = "new"
            texts.append(" ".join(copy).upper() if changes == 1 else " ".join(copy))
    texts += ["", None, "one two", "one two", "w " * 30000]
    rows = [(None if i % 7 == 0 else i // 2, t, "z") for i, t in enumerate(texts)]
    got = simhash.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    import xxhash

    name = lambda t: None if t is None else xxhash.xxh64_intdigest(t.encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), seed=42) >> 63)
    of = {(r["doc_id"], r["text_hash"]): r["component"] for r in got}
    at = [of[i, name(t)] for i, t, _ in rows]
    for k in range(60):
        for c in (1, 2, 3):
            j = jaccard(texts[4 * k], texts[4 * k + c])
            assert at[4 * k] == at[4 * k + c] if j >= 0.9 else j >= 0.6 or at[4 * k] != at[4 * k + c]
    assert len({at[4 * k] for k in range(60)}) == 60
    assert at[240] == at[241] and at[242] == at[243] and len({at[240], at[242], at[244]}) == 3
    assert simhash.near_groups(spark, docs(spark, [])).count() == 0


# 9


def brute_mix(rows, whole=False):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(total.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= 2 * total[s]]
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    return size, total, target


def test_mixing(spark):
    rng = random.Random(31)
    rows = [(i, t, rng.choice(["a", "b", "b", "b", "b", "B", "é", None])) for i, t in enumerate(random_texts(300, 32) + ODD)]
    table = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, source string, size string, target string")
    size, total, target = brute_mix(rows)
    for whole in (False, True):
        got = {r["doc_id"]: r for r in mixing.mix(spark, table, whole=whole).collect()}
        assert len(got) == len(rows)
        taken = Counter()
        for i, _, s in rows:
            r = got[i]
            assert (r["size"], r["source_size"]) == (size[i], total[s]) and r["target"] == pytest.approx(target[s])
            assert 0 <= r["taken"] <= 2 * size[i] and (not whole or r["taken"] in (0, size[i], 2 * size[i]))
            taken[s] += r["taken"]
        for s in total:
            assert abs(taken[s] - target[s]) <= (max(size.values()) / 2 + 1 if whole else 1)
        again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, table.repartition(3), whole=whole).collect()}
        assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(spark, table.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(spark, spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()} == {0}


# 10


def test_quality(spark):
    rng = random.Random(41)
    good = random_texts(200, 42)
    rows, labels = [], []
    for i, t in enumerate(good):
        bad = rng.random() < 0.3
        rows.append((i, " ".join(w + rng.choice(["!!", "###"]) for w in t.split()) if bad else t, "z"))
        labels.append((i, 0 if bad else 1))
    rows += [(500, None, "z"), (501, "", "z"), (502, "w " * 30000, "z"), (0, rows[0][1], "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (501, None), (502, 7), (3, labels[3][1])], "doc_id long, label int")
    got = quality.score(spark, table, marks.where(remainder("doc_id", 5) != 0)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = dict(labels)
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(held) / len(held) >= 0.95
    assert {r["score"] for r in quality.score(spark, table, marks.limit(0)).collect()} == {0.5}
    assert quality.score(spark, table.limit(0), marks).count() == 0
