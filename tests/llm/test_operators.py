"""Operators against brute-force versions, exact round trips and held-out labels."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, words
from tidemark.llm import chat, curriculum, exact_dedup, fertility, jaccard, kit, packing, pseudo_likelihood, quality_gam, substring, toxicity

SF = "/root/testdata/sf0.001"
TOKENIZERS = "/opt/tokenizers"


# --- kit ---


def test_words_are_those_of_python():
    texts = ["a b", "", None, "  lead\ttab\nline ", "x", "é  漢 字"]
    offsets, values = kit.words(pa.array(texts, pa.string()))
    got = [values[a:b].to_pylist() for a, b in zip(offsets, offsets[1:])]
    assert got == [(t or "").split() for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 50])
def test_gram_hashes_tell_grams_apart(n):
    h = np.random.default_rng(n).integers(0, 5, 300).astype(np.uint64)
    grams = kit.gram_hashes(h, n)
    seen = {}
    for i, g in enumerate(grams):
        assert seen.setdefault(tuple(h[i : i + n]), g) == g
    assert len(set(seen.values())) == len(seen) and len(grams) == len(h) - n + 1


@pytest.mark.parametrize("width", [1, 2, 7, 43])
def test_sliding_min(width):
    x = np.random.default_rng(1).integers(0, 100, 200).astype(np.uint64)
    assert kit.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(200 - width + 1)]


# --- 1 exact dedup ---


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, slots = exact_dedup.build_mph(keys)
    assert sorted(slots) == list(range(5000))
    assert (exact_dedup.probe_mph(levels, keys) == slots).all()
    other = exact_dedup.probe_mph(levels, rng.integers(0, 2**63, (5000, 4)).astype(np.uint64))
    assert ((other >= -1) & (other < 5000)).all()


def test_history_wins(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (9, "a"), (8, "c"), (7, "c")])
    got = {r.doc_id: r.winner_id for r in exact_dedup.exact_dedup(docs, history=docs.doc_id == 9).collect()}
    assert got == {1: 9, 2: 9, 9: 9, 3: 3, 4: 3, 7: 7, 8: 7}


def test_winners_come_from_the_slots(spark):
    import hashlib

    digests = {t: hashlib.sha256(t.encode()).digest() for t in "abcd"}
    old = spark.createDataFrame([(bytearray(digests["a"]), 9), (bytearray(digests["b"]), None)], "digest binary, winner long")
    fresh = spark.createDataFrame([(bytearray(digests[t]), i) for i, t in enumerate("abc")], "digest binary, winner long")
    index = exact_dedup.build_index(old, 3)
    got = {bytes(r.digest): r.winner for r in exact_dedup.looked_up(fresh, index, 3).collect()}
    assert got == {digests["a"]: 9, digests["b"]: None, digests["c"]: 2}
    wrong = index.withColumn("locators", F.expr("unhex(repeat('01', length(locators)))"))
    got = {bytes(r.digest): r.winner for r in exact_dedup.looked_up(fresh, wrong, 3).collect()}
    assert got[digests["a"]] == 0x0101010101010101 and got[digests["c"]] == 2


def test_ties_between_repeated_rows_are_settled(spark):
    rows = [(1, "t", "en", f"s{i}") for i in range(20)] + [(2, "t", "en", "z"), (3, "u", "en", "z")]
    got = {tuple(sorted((r.doc_id, r.source) for r in exact_dedup.drop_repeats(frame(spark, rows).repartition(n, "source")).collect())) for n in (1, 3)}
    assert len(got) == 1 and [d for d, _ in got.pop()] == [1, 3]


# --- 2 packing ---


def simulate(queues, shares, window):
    """Deficit round-robin token by token: who owns each token of each window."""
    left = {k: sum(n for _, n in q) for k, q in queues.items()}
    out, since, parts = [], 0, None
    active = sorted(k for k in left if left[k])
    while active:
        parts = sum(shares[k] for k in active)
        edge, at = {}, 0
        for k in active:
            edge[k] = (at, at + shares[k])
            at += shares[k]
        quota = {k: ((since + 1) * window * edge[k][1] // parts - (since + 1) * window * edge[k][0] // parts) - (since * window * edge[k][1] // parts - since * window * edge[k][0] // parts) for k in active}
        give = {k: min(left[k], quota[k]) for k in active}
        dry = any(give[k] < quota[k] for k in active)
        room = window - sum(give.values())
        while room and (rest := [k for k in active if left[k] > give[k]]):
            total = sum(shares[k] for k in rest)
            more = {k: min(left[k] - give[k], room * shares[k] // total) for k in rest}
            if not any(more.values()):
                more = {rest[0]: 1}
            for k, n in more.items():
                give[k] += n
            room = window - sum(give.values())
        out.append({k: n for k, n in give.items() if n})
        for k in active:
            left[k] -= give[k]
        since = 0 if dry else since + 1
        active = [k for k in active if left[k]]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_schedule_is_round_robin(seed):
    rng = random.Random(seed)
    totals = {f"s{i}": rng.randrange(1, 5000) for i in range(6)}
    shares = packing.integer_shares({k: rng.random() + 0.05 for k in totals}, 100)
    windows = defaultdict(dict)
    for r in packing.schedule(totals, shares, 100):
        for j in range(r["windows"]):
            n = r["fixed"] if r["fixed"] >= 0 else packing._given(j + 1, 100, r["low"], r["high"], r["parts"]) - packing._given(j, 100, r["low"], r["high"], r["parts"])
            if n:
                windows[r["first"] + j][r["skey"]] = n
    want = simulate({k: [(0, n)] for k, n in totals.items()}, shares, 100)
    got = [windows[i] for i in range(len(windows))]
    assert [sum(w.values()) for w in got[:-1]] == [100] * (len(got) - 1)
    assert sum(map(sum, (w.values() for w in got))) == sum(totals.values())
    assert len(got) == len(want)
    steady = next(i for i, w in enumerate(want) if len(w) < len(totals) or i == len(want) - 1)
    assert got[: max(0, steady - 1)] == want[: max(0, steady - 1)]


def test_windows_are_full_and_documents_whole(spark):
    rows = [(i, words(1 + i * 37 % 400, i), "en", f"src{i % 5}") for i in range(120)]
    got = packing.pack(frame(spark, rows), window_tokens=500, weights={"src0": 5, "src1": 1, None: 2}).collect()
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_window[r.window_id].append((r.offset, r.n_tokens))
        by_doc[r.doc_id].append((r.start_token, r.n_tokens, r.window_id))
    last = max(by_window)
    for w, pieces in by_window.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 500 or w == last
    for i, text, *_ in rows:
        at = 0
        for start, n, _ in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(text.split())
    first = Counter()
    for r in got:
        if r.window_id == 0:
            first[r.source] += r.n_tokens
    assert abs(first["src0"] - 500 * 5 / 12) < 2 and abs(first["src1"] - 500 / 12) < 2


def test_windows_follow_a_schedule(spark):
    weights, knots, window = {"src0": (12, 8, 4), "src1": (1, 6, 12), None: (4, 4, 4)}, (0.0, 0.5, 1.0), 500
    rng = random.Random(5)
    rows = [(i, words(rng.randrange(1, 300), i), "en", f"src{rng.randrange(3)}") for i in range(400)]
    got = packing.pack(frame(spark, rows), window, weights, knots=knots).collect()
    totals, places, pieces, held = Counter(), defaultdict(list), defaultdict(list), Counter()
    for i, t, _, source in rows:
        totals[source] += len(t.split())
    for r in got:
        places[r.window_id].append((r.offset, r.offset + r.n_tokens))
        pieces[r.doc_id].append((r.start_token, r.window_id, r.n_tokens))
        held[r.window_id, r.source] += r.n_tokens
    horizon = sum(totals.values())
    assert sorted(places) == list(range(-(-horizon // window)))
    for j, spans in places.items():  # every window but the last is full, without gaps or overlaps
        spans = sorted(spans)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == min(window, horizon - j * window)
    for i, t, _, _ in rows:  # every document is whole and in order
        at = 0
        for start, _, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(t.split()) and [w for _, w, _ in sorted(pieces[i])] == sorted(w for _, w, _ in pieces[i])
    share = lambda s, i: weights.get(s, weights[None])[i] / sum(weights.get(q, weights[None])[i] for q in totals)
    given, checked = Counter(), 0
    for j in range(len(places)):
        given.update({s: held[j, s] for s in totals})
        if any(given[s] == totals[s] for s in totals):
            break
        for s in totals:  # the integral of the share, summed numerically
            steps = [(k + 0.5) * (j + 1) * window / 2000 / horizon * 2 for k in range(2000)]
            want = sum(share(s, int(u)) + (share(s, int(u) + 1) - share(s, int(u))) * (u - int(u)) for u in steps) * (j + 1) * window / 2000
            assert abs(given[s] - want) < 2.5
        checked += 1
    assert checked > 20
    assert held[0, "src0"] > 5 * held[0, "src1"]


@pytest.mark.parametrize("seed", range(8))
def test_curved_schedule_gives_all_tokens_once(seed):
    rng = random.Random(seed)
    totals = {f"s{i}": rng.randrange(0, 20_000) for i in range(rng.randrange(1, 6))}
    weights = {k: tuple(rng.choice([0, rng.random() * 9]) for _ in range(4)) for k in totals}
    given, full = Counter(), Counter()
    for r in packing.curved_schedule(totals, weights, (0.0, 0.2, 0.7, 1.0), 100):
        assert r["n0"] == given[r["skey"]]
        for j in range(r["windows"]):
            count = lambda m: packing._edge(m, *r["high"]) - packing._edge(m, *r["low"])
            n = r["fixed"] if r["fixed"] >= 0 else count(j + 1) - count(j)
            assert n >= 0
            given[r["skey"]] += n
            full[r["first"] + j] += n
    assert +given == +Counter(totals)
    assert all(n == 100 for w, n in full.items() if w < max(full)) and sorted(full) == list(range(len(full)))


WIDE = [-(2**63), 2**63 - 1, -9 * 10**18, 9 * 10**18, 0, 1, 2, 3]


def packed_whole(spark, docs, window, **options):
    """The pieces, after checking that windows are full and documents whole."""
    got = packing.pack(docs, window, **options).collect()
    spans, held = defaultdict(list), Counter()
    for r in got:
        spans[r.window_id].append((r.offset, r.n_tokens))
        held[r.doc_id] += r.n_tokens
    for w, pieces in spans.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == window or w == max(spans)
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len((r.text or "").split())
    assert held == +want
    return got


@pytest.mark.parametrize("docs_in_bucket", [2, 10_000])
def test_ids_anywhere(spark, monkeypatch, docs_in_bucket):
    monkeypatch.setattr(packing, "BUCKET_DOCS", docs_in_bucket)
    docs = frame(spark, [(i, words(20, k), "en", f"s{k % 2}") for k, i in enumerate(WIDE + list(range(100, 140)))])
    packed_whole(spark, docs, 64)
    rows = curriculum.mix_sources(docs).collect()
    assert len(rows) == 48 and [r.position for r in rows] == sorted(r.position for r in rows)
    for s in ("s0", "s1"):
        assert [r.doc_id for r in rows if r.source == s] == sorted(r.doc_id for r in rows if r.source == s)


def test_an_outlier_doesnt_fill_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCS", 100)
    docs = spark.range(5000).unionAll(spark.createDataFrame([(9 * 10**18,)], "id long"))
    sizes = docs.groupBy(packing.buckets(docs, "id").alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 400 and len(sizes) > 20


def test_more_sources_than_a_window_has_room_for(spark):
    docs = frame(spark, [(i, words(3 + i % 5, i), "en", f"s{i % 200}") for i in range(600)])
    packed_whole(spark, docs, 256)
    packed_whole(spark, docs, 3)
    curve = {f"s{i}": (1, 2, 3) for i in range(3)} | {None: (0, 1, 0)}
    packed_whole(spark, docs, 256, weights=curve, knots=(0.0, 0.5, 1.0))


def test_small_sources_get_their_shares_over_several_windows(spark):
    docs = frame(spark, [(i, words(10, i), "en", "big") for i in range(1000)] + [(2000 + i, words(10, i), "en", f"t{i % 4}") for i in range(400)])
    weights = {"big": 400, "t0": 1, "t1": 2, "t2": 3, "t3": 4}
    got = packed_whole(spark, docs, 1000, weights=weights)
    assert set(packing.pooled({k: (w,) for k, w in weights.items()}, 1000)) == {"t0", "t1", "t2", "t3"}
    early = Counter()
    for r in sorted((r for r in got if r.source != "big"), key=lambda r: (r.window_id, r.offset))[:150]:
        early[r.source] += r.n_tokens
    assert early["t3"] > 1.5 * early["t1"] > 1.5 * early["t0"]


def test_stored_order_is_the_queue(spark, tmp_path):
    rows = [(i, words(30, i), "en", "a") for i in range(40)]
    frame(spark, rows).orderBy(F.col("doc_id").desc()).coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "docs")), 64, stored=True).collect()
    assert [d for d, _ in itertools.groupby(r.doc_id for r in sorted(got, key=lambda r: (r.window_id, r.offset)))] == list(range(39, -1, -1))


# --- 3 substring dedup ---


def test_repeats_are_those_of_brute_force(spark):
    rng = random.Random(3)
    passages = [words(rng.randrange(20, 90), 100 + i) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [words(rng.randrange(0, 60), 1000 + i)] + [rng.choice(passages) if rng.random() < 0.6 else words(10, 2000 + 50 * i + j) for j in range(3)]
        rows.append((i, " ".join(p for p in parts if p)))
    threshold, where, texts = 25, defaultdict(set), {}
    for i, t in rows:
        texts[i] = t.split()
        for s in range(len(texts[i]) - threshold + 1):
            where[tuple(texts[i][s : s + threshold])].add(i)
    want = set()
    for i, w in texts.items():
        run = None
        for s in range(len(w) - threshold + 2):
            twin = s <= len(w) - threshold and len(where[tuple(w[s : s + threshold])]) > 1
            if twin and run is None:
                run = s
            elif not twin and run is not None:
                want.add((i, run, s - 1 - run + threshold))
                run = None
    got = substring.repeated_passages(frame(spark, rows), threshold=threshold).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == want and want
    assert all(r.other_id != r.doc_id and r.other_id in where[tuple(texts[r.doc_id][r.start_word : r.start_word + threshold])] for r in got)


def test_copies_within_a_flush_are_all_listed(spark):
    rows = [(i, "start " + words(80, 5) + f" end{i}") for i in range(50)]
    got = substring.repeated_passages(frame(spark, rows).coalesce(1)).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and {r.n_words for r in got} == {81}


def test_positions_beyond_the_low_bits(monkeypatch):
    texts = pa.array([words(3000, 1), words(500, 2) + " " + words(3000, 1)])
    want = substring.occurrences(texts, np.array([1, 2]), 50, 8)
    monkeypatch.setattr(substring, "_POSITION_BITS", 4)
    got = substring.occurrences(texts, np.array([1, 2]), 50, 8)
    assert all((a == b).all() for a, b in zip(got, want))
    both = [set(got[0][got[1] == d].tolist()) for d in (1, 2)]
    assert len(both[0] - both[1]) <= 2 and len(both[0]) > 50


# --- 4 language model ---


def coded(texts, n_classes=8):
    offsets, found = pseudo_likelihood.cells(pa.array(texts))
    tokens = (found % (n_classes * pseudo_likelihood.MEMBERS)).astype(np.int64)
    return offsets, tokens, pseudo_likelihood.contexts(offsets, tokens, n_classes * pseudo_likelihood.MEMBERS)


def plain_gradient(model, tokens, around):
    """Log-probability of each token, and the gradient of their sum by all weights, token by token."""
    grads, scores = {k: np.zeros(v.shape) for k, v in model.items()}, []
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, t in enumerate(tokens):
        h = np.tanh(model["bias"].astype(float) + sum(model["embed"][j][around[j, i]] for j in range(len(pseudo_likelihood.PLACES))))
        x = np.r_[h, 1]
        c, m = divmod(int(t), pseudo_likelihood.MEMBERS)
        p, q = soft(x @ model["to_class"]), soft(x @ model["to_member"][c])
        scores.append(math.log(p[c]) + math.log(q[m]))
        p[c] -= 1
        q[m] -= 1
        grads["to_class"] -= np.outer(x, p)
        grads["to_member"][c] -= np.outer(x, q)
        back = -(model["to_class"] @ p + model["to_member"][c] @ q)[:-1] * (1 - h**2)
        grads["bias"] += back
        for j in range(len(pseudo_likelihood.PLACES)):
            grads["embed"][j][around[j, i]] += back
    return scores, grads


def test_scores_and_steps_are_those_of_a_plain_loop():
    model = pseudo_likelihood.new_model(8, 1)
    rng = np.random.default_rng(2)
    for k in ("bias", "to_class", "to_member"):
        model[k][:] = rng.normal(0, 0.3, model[k].shape)
    offsets, tokens, around = coded(["a b c d e a b", "x", "", "b c"])
    assert around[0, 2] == tokens[0] and around[3, 2] == tokens[4] and around[1, 7] == around[2, 7] == 8 * pseudo_likelihood.MEMBERS
    want, grads = plain_gradient(model, tokens, around)
    assert pseudo_likelihood.log_probabilities(model, tokens, around) == pytest.approx(want, abs=1e-4)
    order = np.argsort(tokens, kind="stable")
    new = {k: v.copy() for k, v in model.items()}
    pseudo_likelihood.train_step(new, tokens[order], around[:, order], 0.1)
    n = len(tokens)
    assert new["to_class"] - model["to_class"] == pytest.approx(0.1 * grads["to_class"] / n, abs=1e-5)
    assert new["bias"] - model["bias"] == pytest.approx(0.1 * grads["bias"] / n, abs=1e-5)
    for c, times in Counter((tokens // pseudo_likelihood.MEMBERS).tolist()).items():
        assert new["to_member"][c] - model["to_member"][c] == pytest.approx(0.1 * grads["to_member"][c] / math.sqrt(n * times), abs=1e-5)
    for j in range(len(pseudo_likelihood.PLACES)):
        for t, times in Counter(around[j].tolist()).items():
            assert new["embed"][j][t] - model["embed"][j][t] == pytest.approx(0.1 * grads["embed"][j][t] / math.sqrt(n * times), abs=1e-5)


def test_a_token_is_never_its_own_context():
    _, tokens, around = coded(["q r s t u v w"])
    assert not (around == tokens).any()


def test_frequent_words_have_codes_of_their_own_and_the_vocabulary_grows():
    counts = np.zeros(pseudo_likelihood.CELLS, np.int64)
    counts[:5000] = np.arange(5000, 0, -1)
    codes = pseudo_likelihood.vocabulary(counts)
    size = pseudo_likelihood.classes(int(counts.sum())) * pseudo_likelihood.MEMBERS
    own = size - size // pseudo_likelihood.SHARED
    assert codes[:own].tolist() == list(range(own)) and codes[own:].min() == own and codes.max() == size - 1
    assert pseudo_likelihood.classes(10**9) > 5 * pseudo_likelihood.classes(10**6)


def test_training_beats_unigrams_on_held_out_text():
    rng = np.random.default_rng(0)

    def text(n):
        out = []
        while len(out) < n:
            out += [f"h{rng.integers(20)}"] + [["m", "k", "z"][len(out) % 3], "tail"]
        return " ".join(out)

    model = pseudo_likelihood.new_model(8)
    pseudo_likelihood.train(model, (coded([text(20_000)])[1:] for _ in range(8)))
    _, tokens, around = coded([text(5_000)])
    share = np.bincount(tokens, minlength=8 * pseudo_likelihood.MEMBERS) / len(tokens)
    unigram = float((np.log(share[tokens])).mean())
    assert pseudo_likelihood.log_probabilities(model, tokens, around).mean() > unigram + 0.3


def test_every_token_is_counted_and_a_training_target(spark):
    rows = [(i, words(n, i)) for i, n in enumerate([1, 2, 7, 8, 9, 100, 0, 3])]
    table, counts = pseudo_likelihood.encoded(frame(spark, rows).select("doc_id", "text"))
    total = sum(len(t.split()) for _, t in rows)
    assert counts.sum() == total and table.count() == len(rows)
    codes, k = pseudo_likelihood.vocabulary(counts), pseudo_likelihood.classes(total)
    flat = pseudo_likelihood.flatten(pseudo_likelihood.new_model(k))
    run = pseudo_likelihood._train_partition(flat, codes, k)
    parts = [p for r in range(3) for p in table.filter(f"pmod(xxhash64(doc_id, n_tokens), 3) = {r}").select("n_tokens", "cells").mapInArrow(run, "slice int, seen long, weights binary, salt int").filter("slice = 0").collect()]
    assert sum(p.seen for p in parts) == total


def test_rounds_average_the_partitions_by_their_targets(spark):
    rows = [(i, words(50 + 30 * i, i, 50)) for i in range(6)]
    table, counts = pseudo_likelihood.encoded(frame(spark, rows).repartition(3, "doc_id").select("doc_id", "text"))
    codes, k = pseudo_likelihood.vocabulary(counts), pseudo_likelihood.classes(int(counts.sum()))
    got = pseudo_likelihood.fit(table, codes, k, 1)
    start, total, seen = pseudo_likelihood.flatten(pseudo_likelihood.new_model(k)), 0.0, 0
    for part in table.select("n_tokens", "cells").rdd.mapPartitions(lambda rows: [[(r.n_tokens, bytes(r.cells)) for r in rows]]).collect():
        model = pseudo_likelihood.unflatten(start, k)
        if part:
            tokens = codes[np.frombuffer(b"".join(b for _, b in part), np.int32)].astype(np.int64)
            offsets = np.r_[0, np.cumsum([n for n, _ in part])]
            mixed = np.random.default_rng(len(tokens)).permutation(len(tokens))
            around = pseudo_likelihood.contexts(offsets, tokens, k * pseudo_likelihood.MEMBERS)
            n = pseudo_likelihood.train(model, iter([(tokens[mixed], around[:, mixed])]))
            total, seen = total + pseudo_likelihood.flatten(model).astype(float) * n, seen + n
    assert got == pytest.approx(total / seen, abs=1e-4)


def test_steps_with_many_classes_keep_class_logits_small_and_their_gradients(monkeypatch):
    """As classes grow with the corpus, a step's class logits stay in blocks of rows; the step is that of the plain formulas."""
    softmax, shapes = pseudo_likelihood._softmax, []
    monkeypatch.setattr(pseudo_likelihood, "_softmax", lambda x: (shapes.append(x.shape), softmax(x))[1])
    rng, n_classes, n = np.random.default_rng(0), 160, 3000
    codes = n_classes * pseudo_likelihood.MEMBERS
    tokens, around = np.sort((codes * rng.random(n) ** 3).astype(np.int64)), (codes * rng.random((4, n)) ** 3).astype(np.int64)
    model = pseudo_likelihood.new_model(n_classes)
    model["to_class"][:] = rng.normal(0, 0.1, model["to_class"].shape)
    model["to_member"][:] = rng.normal(0, 0.1, model["to_member"].shape)
    want = {k: x.astype(float) for k, x in model.items()}
    pseudo_likelihood.train_step(model, tokens, around, 2.0)
    assert max(rows for rows, columns in shapes if columns == n_classes) <= 1024
    group, member = tokens // pseudo_likelihood.MEMBERS, tokens % pseudo_likelihood.MEMBERS
    h = np.c_[np.tanh(sum(want["embed"][j][around[j]] for j in range(4)) + want["bias"]), np.ones(n)]
    p = np.exp(h @ want["to_class"])
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), group] -= 1
    q = np.exp(np.einsum("nh,nhm->nm", h, want["to_member"][group]))
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(n), member] -= 1
    back = p @ want["to_class"].T + np.einsum("nm,nhm->nh", q, want["to_member"][group])
    inner = (back * (1 - h**2))[:, :-1]
    want["to_class"] -= 2 / n * h.T @ p
    want["bias"] -= 2 / n * inner.sum(axis=0)
    for c in set(group):
        x = group == c
        want["to_member"][c] -= 2 / (n * x.sum()) ** 0.5 * h[x].T @ q[x]
    for j in range(4):
        times, sums = np.bincount(around[j], minlength=codes + 1), np.zeros((codes + 1, inner.shape[1]))
        np.add.at(sums, around[j], inner)
        want["embed"][j] -= 2 * sums / np.sqrt(np.maximum(times, 1) * n)[:, None]
    for k in model:
        assert np.abs(model[k] - want[k]).max() < 1e-4, k
    for most in (1000, 1 << 17):
        some = rng.integers(0, most, 5000)
        assert (pseudo_likelihood._order(some) == np.argsort(some, kind="stable")).all()


# --- 5 n-gram Jaccard ---


@pytest.mark.parametrize("n,threshold", [(1, 0.8), (3, 0.7), (5, 0.6)])
def test_pairs_are_those_of_brute_force(spark, n, threshold):
    rng = random.Random(n)
    rows = []
    for g in range(12):
        base = words(rng.randrange(3, 150), 10 * g + n, 300).split()
        for _ in range(5):
            edited = [w if rng.random() > 0.04 else "new" + str(rng.randrange(999)) for w in base]
            rows.append((len(rows), " ".join(edited)))
    rows.append((len(rows), rows[0][1] + " " + rows[0][1]))
    sets, heads, want = {}, {}, set()
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))}
        heads.setdefault(t, i)
    for i, t in rows:
        if heads[t] != i:
            want.add((heads[t], i))
    for a, b in itertools.combinations(sorted(heads.values()), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            want.add((a, b))
    got = jaccard.similar_pairs(frame(spark, rows), threshold, n).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == want and len(want) > 10


def copies(n: int, size: int, share: float, seed: int) -> list[str]:
    """Texts that each change a share of one text's words."""
    rng = random.Random(seed)
    base = words(size, seed, 5000).split()
    return [" ".join(w if rng.random() > share else f"new{rng.randrange(400)}" for w in base) for _ in range(n)]


def test_links_of_large_groups_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 40)  # a grid of tiles
    texts = copies(110, 60, 0.06, 1) + copies(60, 12, 0.08, 2) + copies(5, 200, 0.05, 3) + [words(90, i) for i in range(4, 20)] + ["one", "two", "one two"]
    texts += texts[:7] + texts[112:115]
    sets, head = [set(t.split()) for t in texts], {t: i for i, t in reversed(list(enumerate(texts)))}
    only = sorted(head.values())
    near = {(a, b) for a, b in itertools.combinations(only, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    docs = frame(spark, list(enumerate(texts)))
    pairs = jaccard.similar_pairs(docs).collect()
    assert len(pairs) == len({(r.doc_a, r.doc_b) for r in pairs})
    assert {(r.doc_a, r.doc_b) for r in pairs} == near | {(head[t], i) for i, t in enumerate(texts) if head[t] != i} and len(near) > 1000
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    links = [sum(head[t] in p for p in near) for t in texts]
    got = sorted(tuple(r) for r in jaccard.near_classes(docs).collect())
    assert got == [(i, group[head[t]], links[i]) for i, t in enumerate(texts)]


def test_rows_follow_documents_and_candidates_follow_texts(spark):
    texts = copies(300, 80, 0.04, 5)
    docs = frame(spark, list(enumerate(texts)))
    got = jaccard.near_classes(docs).collect()
    assert len(got) == 300 and sum(r.n_links for r in got) > 30_000
    pairs, group = jaccard._candidates(jaccard._known(docs, "doc_id", "text"), 1, 0.8, None)
    assert group.count() > 250 and pairs.count() < 300


def test_false_agreement_of_signatures_loses_no_pair():
    """Where signatures agree in a block that differs, the pair is still taken at the blocks that agree."""
    rng, lost = random.Random(3), 0
    for i in range(1500):
        base = [f"b{rng.randrange(10**6)}" for _ in range(45)]
        other = base[5:] + [f"c{rng.randrange(10**6)}" for _ in range(5)]  # 40 of 50
        edges, grams = jaccard.gram_sets(pa.array([" ".join(base), " ".join(other)]), 1)
        key, text, *rest = jaccard.block_rows(edges, grams, 0.8)
        blob = kit.packed([(key & jaccard.U64(0xFFFFFFFF)).astype("u4"), text.astype("i8"), *rest])
        got = jaccard._meet(0.8)(pa.table({"rows": pa.array([blob], pa.binary())}))
        lost += got.num_rows != 1 or got["star"][0].as_py()
    assert lost == 0


def test_unlike_texts_of_common_words_are_not_tied():
    """Texts that share frequent words only meet on many blocks, but not in half of a group's."""
    rng = np.random.default_rng(0)
    often = 0.6 / (1 + np.arange(400) / 4)  # a word's share of the texts
    sets = []
    for i in range(5000):
        some = np.flatnonzero(rng.random(400) < often)
        sets.append(np.r_[some, rng.integers(400, 200_000, 120)])
    for i in range(100):  # near copies of one
        sets.append(np.r_[sets[0][:-4], 300_000 + 4 * i + np.arange(4)])
    grams = [np.unique(jaccard.mix(s.astype("u8")) & jaccard._LOW) for s in sets]
    edges, flat = np.r_[0, np.cumsum([len(g) for g in grams])], np.concatenate(grams)
    seen = np.bincount(jaccard.cells(flat), minlength=jaccard.CELLS)
    key, text, *rest = jaccard.block_rows(edges, flat, 0.8, np.round(16 * np.log2((seen.max() + 1) / (seen + 1))) + 1)
    blob = kit.packed([(key & jaccard.U64(0xFFFFFFFF)).astype("u4"), text.astype("i8"), *rest])
    got = jaccard._meet(0.8)(pa.table({"rows": pa.array([blob], pa.binary())})).to_pylist()
    tied = {x for r in got if r["star"] for x in (r["a"], r["b"])}
    assert {0, *range(5000, 5100)} <= tied and len(tied) < 200 and len(got) < 500


def test_texts_that_agree_with_few_are_paired_and_not_tied():
    """200 texts on one block, each like its next neighbours only: tied by stars they would be one group, as more and more unlike texts are in a large corpus."""
    i = np.arange(200)
    signature = np.ascontiguousarray(1 + (i[:, None] + np.arange(16)) // 16, np.uint8).view("u8")
    columns = [np.zeros(200), i, *signature.T, np.full(200, 90), np.ones(200)]
    blob = kit.packed([c.astype(k) for c, k in zip(columns, jaccard._KINDS)])
    got = jaccard._meet(0.8)(pa.table({"rows": pa.array([blob], pa.binary())})).to_pylist()
    assert not any(r["star"] for r in got)
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(200) for b in range(a + 1, min(a + 8, 200))]  # 9 of 16 blocks besides the common one


def test_texts_meet_on_the_most_telling_block_that_they_agree_in():
    """A row's signatures are those of less telling blocks, and blocks that both agree in have one order."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 44, 100).astype("u8"))
    other = np.unique(np.r_[base[6:], rng.integers(0, 1 << 44, 6).astype("u8")])
    says = np.arange(jaccard.CELLS) % 97
    key, text, *words, size, own = jaccard.block_rows(np.array([0, 100, 100 + len(other)]), np.r_[base, other], 0.8, says)
    signature = np.stack(words, axis=1).view("u1")
    less = (signature > 0).sum(axis=1)
    assert less.min() == 7 and less.max() == 15
    met = {k: np.flatnonzero(key == k) for k in set(key[text == 0]) & set(key[text == 1])}
    both = [int(((signature[x] == signature[y]) & (signature[x] > 0)).sum()) for x, y in met.values()]
    assert max(both) >= 7


def test_short_texts_send_as_many_blocks_as_may_differ_and_one():
    """Of any two similar sets one block at least is sent by both, at sizes where that takes fewer than half of a group."""
    rng = random.Random(5)
    for size in range(1, 90):
        for _ in range(20):
            base = [rng.randrange(1 << 40) for _ in range(size)]
            drop, add = rng.randrange(size // 9 + 1), rng.randrange(size // 9 + 1)
            sets = [np.unique(np.array(x, "u8")) for x in (base, base[drop:] + [rng.randrange(1 << 40) for _ in range(add)])]
            both = len(np.intersect1d(*sets))
            if both >= 0.8 * (len(sets[0]) + len(sets[1]) - both):
                key, text, *_ = jaccard.block_rows(np.r_[0, np.cumsum([len(x) for x in sets])], np.concatenate(sets), 0.8)
                assert set(key[text == 0]) & set(key[text == 1])
    key, *_ = jaccard.block_rows(np.array([0, 5]), np.arange(5, dtype="u8"), 0.8)
    assert len(key) <= 4


def test_tiles_of_one_group_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 40)
    texts = spark.range(400).select(F.col("id").alias("tid"), F.lit(10).alias("size"))
    group = texts.select("tid", F.lit(0).cast("long").alias("group_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tiles = jaccard._grids(group, texts, lambda t: pa.table({"tid": t["tid"][:1]}), "tid long").select(F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tiles) == 55 and len({r.p for r in tiles}) > 1


def test_blank_texts_are_told_at_any_length(spark):
    texts = ["", " ", "\t\n\r\x0b\x0c " * 40, " " * 64 + "x", "\n" * 500 + "é", "x" + " " * 500, " " * 63 + "\u00a0", "word"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(jaccard._blank(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [True, True, True, *[False] * 5]


def test_memory_is_given_back_after_each_group(monkeypatch):
    trims = []
    monkeypatch.setattr(kit, "trim", lambda: trims.append(1))
    pairs, texts = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}), pa.table({"tid": pa.array([], pa.int64())})
    for judge in (jaccard._far, jaccard._verify):
        assert judge(0.8)(pairs, texts).num_rows == 0
    blob = kit.packed([np.zeros(2, k) for k in jaccard._KINDS])
    assert jaccard._meet(0.8)(pa.table({"rows": pa.array([blob], pa.binary())})).num_rows == 0
    assert len(trims) == 3


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 40_000, 7).select((F.col("id") - 20_000).alias("k"))
    values = spark.range(-20_000, 20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("v"))
    got = {r.v for r in values.filter(kit.maybe_in(keys, "k")("v")).collect()}
    want = {r.k for r in keys.collect()} - {5}
    assert want <= got and len(got - want) < 400 and None not in got
    assert values.filter(kit.maybe_in(keys.limit(0), "k")("v")).count() == 0


def python_steps(df):
    """The most Python steps that one task of the planned stages runs, each in a worker of its own."""
    most = 0

    def walk(node):
        nonlocal most
        node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        below = max((walk(node.children().apply(i)) for i in range(node.children().size())), default=0)
        here = 0 if "Exchange" in node.nodeName() else below + any(x in node.nodeName() for x in ("Python", "Pandas", "Arrow"))
        most = max(most, here)
        return here

    walk(df._jdf.queryExecution().executedPlan())
    return most


@pytest.mark.parametrize("run", [lambda docs: jaccard.keep_one(docs), lambda docs: jaccard.near_classes(docs)])
def test_no_task_of_the_jaccard_join_keeps_two_workers(spark, monkeypatch, run):
    steps = []
    monkeypatch.setattr(jaccard, "durable", lambda df, held=None: steps.append(python_steps(df)) or kit.durable(df, held))
    rows = [(i, words(100, i)) for i in range(4)] + [(10 + i, words(100, i) + " x") for i in range(4)] + [(20 + i, words(60, 9) + f" y{i}") for i in range(40)]
    steps.append(python_steps(run(frame(spark, rows))))
    assert max(steps) == 1


def test_no_task_of_mixing_and_packing_keeps_two_workers(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCS", 10)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [python_steps(df) for df in (curriculum.mix_sources(docs), packing.pack(docs, 256, weights={"src0": 1, None: 1}))] == [1, 1]


@pytest.mark.parametrize("weights", [{"a": 1}, {"src0": 1000, None: 1}])
def test_small_tables_of_the_driver_start_no_workers(spark, weights):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rising = {k: (w, w, w) for k, w in weights.items()}
    for df in (curriculum.mix_sources(docs), packing.pack(docs, 256, weights=weights), packing.pack(docs, 256, weights=rising, knots=(0.0, 0.5, 1.0))):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_local_tables_hold_their_rows(spark):
    rows = [("a", 2**62, (0.5, -1.0, 2.0)), (None, -1, (0.0, 1.0, 3.5))]
    schema = pa.schema([("k", pa.string()), ("n", pa.int64()), ("line", packing._LINE)])
    assert [(r.k, r.n, tuple(r.line)) for r in kit.local_table(spark, rows, schema).collect()] == rows
    none = kit.local_table(spark, [], schema)
    assert none.columns == ["k", "n", "line"] and none.count() == 0


def test_one_of_each_group_stays_by_id_and_text(spark):
    w = words(100, 1)
    docs = frame(spark, [(1, w), (2, w + " x"), (2, "a wholly different text"), (3, w), (3, w), (4, words(100, 2)), (4, words(100, 2))])
    got = sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert got == sorted([(1, w), (2, "a wholly different text"), (4, words(100, 2)), (4, words(100, 2))])


def test_sketch_distance_bounds_the_difference():
    rng = random.Random(0)
    for _ in range(50):
        a = [f"x{rng.randrange(400)}" for _ in range(100)]
        b = [w if rng.random() > 0.05 else "y" + w for w in a]
        edges, grams = jaccard.gram_sets(pa.array([" ".join(a), " ".join(b)]), 1)
        key, text, *_ = jaccard.block_rows(edges, grams, 0.88)
        if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.88:
            assert set(key[text == 0]) & set(key[text == 1])


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    sets = [rng.choice(4000, n, replace=False) for n in (40, 300, 900, 1500)]
    texts = pa.array([" ".join(f"w{x}" for x in s) for s in sets])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), texts], names=["tid", "text"])
    rows = [r for b in jaccard._profile(1)(iter([batch])) for r in b.to_pylist() if r["tid"]]
    for x, y in itertools.combinations(range(4), 2):
        low = min(len(rows[x]["long"]), len(rows[y]["long"])) * 8
        a, b = (jaccard.folded(np.frombuffer(rows[i]["long"], np.uint8)[None], low) for i in (x, y))
        far, differ = int(np.bitwise_count(a ^ b).sum()), len(set(sets[x]) ^ set(sets[y]))
        assert far <= differ and far % 2 == differ % 2 and far > 0.1 * min(differ, low)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 1)]
    pairs = spark.createDataFrame(edges + [(20 + i, 21 + i) for i in range(30)], "doc_a long, doc_b long")
    got = {r.doc_id: r.group_id for r in jaccard.components(pairs).collect()}
    assert {d for d, g in got.items() if g == 1} == {1, 2, 3, 6, 7, 8, 9} and got[5] == 4 and {got[20 + i] for i in range(31)} == {20}


# --- 6 fertility ---


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies here")
def test_measures_are_those_of_word_by_word_tokens():
    v = fertility.Vocabularies(TOKENIZERS)
    texts = ["The quick brown fox, the lazy dog.", None, "漢字 \U0001f600 mixed", words(300, 2)]
    got = fertility.measures(pa.array(texts, pa.string()), v)
    for i, t in enumerate(texts):
        pieces = [p for w in (t or "").split() for p in v.piece.encode(w)]
        chars = sum(map(len, (t or "").split()))
        assert got["n_tokens"][i] == len(pieces)
        if pieces:
            shares = np.array(list(Counter(pieces).values())) / len(pieces)
            assert got["entropy"][i] == pytest.approx(-(shares * np.log2(shares)).sum())
            assert got["chars_per_token"][i] == pytest.approx(chars / len(pieces))
            assert got["byte_share"][i] == pytest.approx(sum(v.piece.is_byte(p) for p in pieces) / len(pieces))


def test_a_text_of_more_words_than_are_remembered_is_measured(monkeypatch):
    text = words(3000, 1, 100_000)
    want = fertility.measures(pa.array([text, "a b"]), fertility.Vocabularies(TOKENIZERS))
    monkeypatch.setattr(fertility, "_REMEMBERED", 100)
    v = fertility.Vocabularies(TOKENIZERS)
    for _ in range(2):
        got = fertility.measures(pa.array([text, "a b"]), v)
        assert all((got[k] == want[k]).all() for k in want)
        fertility.measures(pa.array(["c d"]), v)


def test_junk_goes_and_text_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    got = fertility.fertility(docs).join(docs.select("doc_id", "quality"), "doc_id").toPandas()
    assert got[got.quality == 1].reason.isna().mean() > 0.97
    assert got[(got.quality == 0)].reason.notna().mean() > 0.4


PROSE = {
    "en": "The committee met on Thursday to discuss the new budget, and after a long debate about the cost of repairing the old bridge it was decided to put the question to a vote. Several members complained that the figures they had been given were out of date, while others pointed out that waiting another year would only make the work more expensive. In the end the proposal was accepted by a narrow majority.",
    "de": "Am Donnerstag kam der Ausschuss zusammen, um über den neuen Haushalt zu sprechen, und nach einer langen Debatte wurde beschlossen, die Frage zur Abstimmung zu stellen. Mehrere Mitglieder beklagten sich, dass die Zahlen veraltet seien, während andere darauf hinwiesen, dass ein weiteres Jahr des Wartens die Arbeiten nur verteuern würde.",
    "fr": "Le comité s'est réuni jeudi pour discuter du nouveau budget, et après un long débat sur le coût de la réparation du vieux pont, il a été décidé de mettre la question aux voix. Plusieurs membres se sont plaints que les chiffres n'étaient plus à jour, tandis que d'autres ont fait remarquer qu'attendre ne ferait que rendre les travaux plus chers.",
    "es": "El comité se reunió el jueves para discutir el nuevo presupuesto y, después de un largo debate sobre el costo de la reparación del viejo puente, se decidió someter la cuestión a votación. Varios miembros se quejaron de que las cifras estaban desactualizadas, mientras que otros señalaron que esperar solo encarecería las obras.",
}


def test_real_prose_stays_and_junk_goes_at_any_length(spark):
    rows = [(i, " ".join(PROSE[lang].split()[:n]), lang, "a") for i, (lang, n) in enumerate(itertools.product(PROSE, (3, 8, 20, 500)))]
    kept = fertility.fertility(frame(spark, rows)).filter("reason IS NULL").count()
    assert kept == len(rows)
    junk = ["la " * 40, "la " * 400, "$$ %% ## @@ !! " * 60, "kJx9Qz7+/Wq0Zp3rT8vY2nB5mC1sD4fG6hL " * 30, "\u0f3a\u0f3b\u0f3c\u0f3d" * 20]
    got = fertility.fertility(frame(spark, [(i, t, "en", "a") for i, t in enumerate(junk)])).filter("reason IS NOT NULL")
    assert got.count() == len(junk)


def test_rules_are_those_of_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v = fertility.Vocabularies(TOKENIZERS)
    kept = {r.doc_id for r in fertility.keep_natural(docs).collect()}
    for r in docs.collect():
        w = r.text.split()
        pieces, coarse = [p for x in w for p in v.piece.encode(x)], sum(len(v.bytes.encode_ordinary(" " + x)) for x in w)
        n, chars = len(pieces), sum(map(len, w))
        low, high, least, most, share, entropy = fertility.BANDS.get(r.lang) or fertility.SCRIPT_BANDS["latin" if len(r.text.encode()) <= 1.6 * len(r.text) else "other"]
        good = n > 0
        if good:
            wide, counts = 2 / math.sqrt(n), Counter(pieces)
            bits = -sum(c / n * math.log2(c / n) for c in counts.values())
            good = max(0, 1 - wide) * low <= chars / n <= high * (1 + wide) and max(0, 1 - wide) * least <= chars / coarse <= most * (1 + wide)
            good &= sum(v.piece.is_byte(p) for p in pieces) / n <= share + wide and bits >= entropy * min(math.log2(n), 7.5) * max(0, 1 - wide / 4) - 1e-9
        assert good == (r.doc_id in kept)


# --- 7 chat ---


def test_every_turn_is_new_once_and_windows_fit(spark):
    rng = random.Random(5)
    rows = []
    for c in range(6):
        rows.append((c, 0, "system", words(10, c)))
        rows += [(c, t, ("user", "assistant")[t % 2], words(rng.randrange(1, 40), 100 * c + t)) for t in range(1, 60)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = {(c, t): (r, x) for c, t, r, x in rows}
    seen, aims = Counter(), Counter()
    for w in chat.chat_windows(conversations, budget=400, history=120).collect():
        assert w.over_budget == (w.n_tokens > 400) and not w.over_budget
        assert w.text.startswith("<|system|>\n" + texts[w.conv_id, 0][1])
        for t in range(w.first_turn, w.last_turn + 1):
            seen[w.conv_id, t] += 1
        assert w.last_turn - w.first_turn + 1 == w.n_turns and (w.window == 0) == (w.n_repeated == 0)
        for s in w.targets:
            aims[w.conv_id, w.text[s.begin : s.end]] += 1
    assert set(seen.values()) == {1} and len(seen) == 6 * 59
    assert set(aims) == {(c, x) for (c, _), (r, x) in texts.items() if r == "assistant"}


def plain_windows(turns, budget, history):
    """Windows of one conversation's (turn, role, text, tokens) by trying every span: (first, last, repeated turns, targets' texts, tokens)."""
    lead = list(itertools.takewhile(lambda t: t[1] == "system", turns))
    rest, out, at = turns[len(lead) :], [], 0
    held = sum(t[3] for t in lead)
    if not rest:
        return [(lead[0][0], lead[-1][0], 0, [], held)] if lead else []
    while at < len(rest):
        back = min((b for b in range(at + 1) if sum(t[3] for t in rest[b:at]) <= history))
        if held + sum(t[3] for t in rest[back : at + 1]) > budget:
            back = at
        end = max([at + 1, *(e for e in range(at + 1, len(rest) + 1) if held + sum(t[3] for t in rest[back:e]) <= budget)])
        new = rest[at:end]
        out.append((new[0][0], new[-1][0], at - back, [t[2] for t in new if t[1] == "assistant"], held + sum(t[3] for t in rest[back:end])))
        at = end
    return out


def test_windows_are_those_of_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t < c % 3 else rng.choice(["user", "assistant", "tool"])
            rows.append((c, t, role, words(rng.choice([0, 1, 5, 30, 90]), 100 * c + t)))
    rows += [(50, t, ("user", "assistant")[t % 2], words(3, t)) for t in range(3000)]  # a very long conversation
    rows += [(51, 0, "user", words(4000, 1)), (51, 1, "assistant", words(5, 2)), (51, 2, "user", words(5, 3))]  # a long turn, then history
    from tidemark.llm.fertility import Vocabularies

    cut = Vocabularies(TOKENIZERS).bytes.encode_ordinary
    want = {}
    for c, own in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(t, r, x, chat.FRAME + len(cut(x))) for _, t, r, x in own]
        want |= {(c, i): w for i, w in enumerate(plain_windows(turns, 300, 90))}
    got = {(w.conv_id, w.window): (w.first_turn, w.last_turn, w.n_repeated, [w.text[s.begin : s.end] for s in w.targets], w.n_tokens) for w in chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 300, 90).collect()}
    assert got == want


# --- 8 toxicity, 10 quality ---


def test_toxic_documents_are_found(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = words(60, i, 500).split()
        toxic = i % 8 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["Grobbel!", "grobbelig", "snarfwit,"])
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].is_toxic == (i % 8 == 0) for i in range(300, 400))


def test_chain_features_are_out_of_fold():
    rng = np.random.default_rng(0)
    text, term = np.nonzero(rng.integers(0, 2, (300, 40)))
    noise = rng.integers(0, 2, 300).astype(float)
    models = toxicity.fit_chain(text, term, 40, [noise, noise.copy()], np.arange(300) % toxicity.FOLDS)
    assert models[1][40] < 1  # in-sample predictions of noise would be trusted fully, held-out ones are not


def test_logistic_fit_is_that_of_plain_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (200, 6))
    y = (x[:, 0] + x[:, 1] + rng.random(200) > 1.6).astype(float)
    use = np.arange(200) % 5 > 0
    text, term = np.nonzero(x)
    got = toxicity._logistic(text, term, 6, np.zeros((200, 0)), y, use)
    a, b = x[use & (y > 0)].sum(axis=0), x[use & (y == 0)].sum(axis=0)
    n, m = (use & (y > 0)).sum(), (use & (y == 0)).sum()
    scale = np.log((a + 0.5) / (n + 1) * (m + 1) / (b + 0.5))
    z, w, c = x * scale, np.zeros(6), 0.0
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(z @ w + c))) - y) * use / use.sum()
        w, c = w - 0.5 * (z.T @ off + 1e-3 * w), c - 0.5 * off.sum()
    assert np.abs(got - np.r_[w * scale, c]).max() < 0.05


def test_a_labelled_document_of_many_rows_is_one_row_of_the_sample(spark):
    docs = frame(spark, [(1, "a b")] * 50 + [(1, "a a")] + [(2, "c")])
    chosen = toxicity.sample_of(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int"), [F.col("quality"), F.col("toxic")], 9)
    got = sorted((r.doc_id, r.labels, r.text) for r in toxicity.sampled(docs.select("doc_id", "text"), chosen).collect())
    assert got == [(1, [1, 1], "a a"), (2, [1, 0], "c")]


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    train, test = labels.filter("doc_id % 4 > 0"), labels.filter("doc_id % 4 = 0")
    got = quality_gam.quality(docs, train).join(test, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.95 and (got.keep == (got.quality == 1)).mean() > 0.9


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_model(x, y)
    assert ((model.score(x) > 0) == (y > 0)).mean() > 0.95  # the exclusive or needs a pair
    want = model.intercept + sum(t[np.searchsorted(e, x[7, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    want += sum(t[np.searchsorted(model.pair_edges[i], x[7, i], side="right"), np.searchsorted(model.pair_edges[j], x[7, j], side="right")] for i, j, t in model.pairs)
    assert model.score(x)[7] == pytest.approx(want)


# --- 9 mixing ---


def test_positions_meet_the_integrated_demand(spark):
    rows = [(i, words(20 + i % 30, i), "en", f"s{i % 3}") for i in range(90)]
    weights = {"s0": (1, 1, 6), "s1": (6, 1, 1)}
    got = curriculum.mix_sources(frame(spark, rows), weights, default=(2, 2, 2)).collect()
    horizon = sum(len(t.split()) for _, t, *_ in rows)
    chosen = {f"s{i}": weights.get(f"s{i}", (2, 2, 2)) for i in range(3)}
    steps = np.linspace(0, 4 * horizon, 400_001)
    share = {}
    for k, w in chosen.items():
        knots = [w[i] / sum(x[i] for x in chosen.values()) for i in range(3)]
        share[k] = np.interp(steps / horizon, [0, 0.5, 1], knots)
    before = Counter()
    for r in sorted(got, key=lambda r: r.doc_id):
        demand = np.r_[0, np.cumsum((share[r.source][1:] + share[r.source][:-1]) / 2 * np.diff(steps))]
        assert r.position == pytest.approx(np.interp(before[r.source], demand, steps), abs=1.5)
        before[r.source] += r.n_tokens
    assert [r.position for r in got] == sorted(r.position for r in got)
