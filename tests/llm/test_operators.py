"""Operators against brute force, round trips and held-out accuracy, and on odd input."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, exact_dedup, language, lm, mixing, ngram_join, toxicity, url_filter, warc
from lodestone.llm.url_filter import RULES

DOCS = "doc_id long, text string, lang string, source string, k long, sid int, id string, score double"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5) for r in rows], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# ---------------------------------------------------------------- exact deduplication


def dedup_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    out, seen = [], set()
    for r in rows:
        ids = groups[lower(r[1])]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = (r[0], lower(r[1])) not in seen
        seen.add((r[0], lower(r[1])))
        out.append((r[0], keep, len(ids), r[0] == keep and first, hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = [(1, "Same", "en", "a"), (2, "same", None, "a"), (3, None, "en", None), (4, "", "en", "b"), (4, "", "en", "b"), (None, "same", "en", "a"), (None, "alone", "en", "a"), (5, "É", "fr", "a"), (6, "é", "fr", "a"), (7, "x " * 60_000, "en", "a"), (8, "\u0000 ퟿", "en", "a")]


def test_exact_dedup(spark):
    rows = ODD + [(100 + i, f"text {i % 40}", "en", "a") for i in range(200)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == dedup_brute(rows)
    three = exact_dedup.exact_dedup(docs_of(spark, rows), loads=3).collect()
    assert sorted(map(tuple, three), key=str) == dedup_brute(rows)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).collect() == []


def test_kept_rows(spark):
    d = docs_of(spark, ODD)
    got = exact_dedup.kept(d)
    assert got.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None) == sorted((r[0], r[1]) for r in [ODD[1], ODD[3], ODD[7], ODD[8], ODD[9], ODD[10]])


CLASH = "doc_id long, text string, own string, winner int, digest int, turn int, dropped int, stays int, leak string, __id int, __own int, __leak int, s int, n int, v int"


def test_kept_rows_of_clashing_names(spark):
    d = spark.createDataFrame([(*r[:2], "a", *[7] * 5, "x", *[8] * 6) for r in ODD], CLASH)
    for got in (exact_dedup.kept(d), ngram_join.kept(d), decontamination.decontaminated(d, spark.createDataFrame([(1, "x x x x x x x")], "item_id long, text string"))):
        assert got.columns == d.columns and 0 < len(got.collect()) < len(ODD)


def test_hot_null_ids(spark):
    """A third of all rows has no id, and one text."""
    rows = [(None, "same text", "en", "s")] * 600 + [(i, f"t {i % 500}", "en", "s") for i in range(1200)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    hot = [r for r in got if r["doc_id"] is None]
    assert len(got) == 1800 and all((r["keep_id"], r["group_size"]) == (None, 600) for r in hot) and sum(r["kept"] for r in hot) == 1 and sum(r["kept"] for r in got) == 501
    assert exact_dedup.kept(docs_of(spark, rows)).count() == 501
    taken = mixing.mix(docs_of(spark, rows)).groupBy().sum("taken").first()[0]
    assert abs(taken - 3600) <= 36


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        exact_dedup.exact_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError):
        warc.archived(spark.createDataFrame([("a", "b", "c")], "page_id string, url string, html string"))
    assert ngram_join.ngram_join(spark.createDataFrame([("a", "b"), ("c", "b")], "doc_id string, text string")).where("component_id = 'a'").count() == 2


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 20_000, dtype=np.uint64))
    h = exact_dedup.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys))) and len(h.bits) < 4 * len(keys)
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(keys[[0, 0]])


def test_tied_placing_bits_are_kept_beside():
    a, b = b"\1" * 8 + b"\7" * 8 + b"\2" * 16, b"\3" * 8 + b"\7" * 8 + b"\4" * 16
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([a, b], pa.binary()), pa.array([5, 6]), pa.array([0, 3]), pa.array([1, 2])], ["shard", "digest", "winner", "row", "size"])
    index = next(exact_dedup._indexed([batch]))
    ask = pa.RecordBatch.from_arrays(
        [pa.array([0, 0, 0], pa.int32()), pa.array([0, 1, 1], pa.int32()), pa.array([None, a, b], pa.binary()), pa.array([0, 9, 6]), pa.array([0, 1, 2]), pa.array([0, 1, 1])] + [pa.array([index.column(c)[0].as_py(), None, None], index.column(c).type) for c in ("keys", "bits", "levels", "slots")],
        ["shard", "kind", "digest", "winner", "row", "size", "keys", "bits", "levels", "slots"],
    )
    got = {r["digest"]: (r["winner"], r["row"], r["size"], r["member"]) for b_ in exact_dedup._looked_up([ask]) for r in b_.to_pylist()}
    assert got == {a: (9, 1, 2, True), b: (6, 3, 3, True)}


# ---------------------------------------------------------------- toxicity and language


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    vocab = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(150)] for lang, s in {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "eit", "ä"], "fr": ["eau", "tion", "é", "oi"]}.items()}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(vocab))
        text = [rng.choice(vocab[lang]) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["idiotic", "idiots", "stupidly", "stupid", "worthless"])
        rows.append((i, " ".join(text), lang, "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = corpus(400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (None, "worthless idiots", "en", "s"), (1002, "thing " * 30_000 + "stupid idiot worthless", "en", "s")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs_of(spark, rows + odd), lab).collect()}
    own = [i for i, _, _ in labels if held(i)]
    assert sum(got[i]["predicted"] == labels[i][2] for i in own) / len(own) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got.values())
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[None]["predicted"] == 1 and got[1002]["predicted"] == 1
    assert toxicity.toxicity(docs_of(spark, rows[:2]), lab.limit(0)).where("predicted = 1 or score > 0").count() == 0
    assert toxicity.toxicity(docs_of(spark, []), lab).count() == 0
    model = toxicity.train(docs_of(spark, rows), lab)
    left = toxicity.kept(docs_of(spark, rows + odd), model)
    assert left.columns == docs_of(spark, []).columns and {r["doc_id"] for r in left.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_unseen_spelling_shares_subwords(spark):
    rows, labels = corpus(400)
    m = toxicity.fit(pa.array([r[1] for r in rows]), np.array([x[2] for x in labels]))
    z = m.logits(pa.array(["stupidest", "xylophone", "", None, "stup1dly"]))
    assert z[0] > 0 > z[2] == z[3] and z[0] > z[1] and z[4] > z[1]


def test_language(spark):
    rows, _ = corpus(300)
    odd = [(1000, None, "en", "s"), (1001, "123 !?", "de", "s"), (1002, "", None, "s"), (1003, "schungeit " * 40_000, None, "s"), (None, "schung eit", "de", "s"), (0, rows[0][1], "en", "s")]
    got = [r for r in language.language(docs_of(spark, rows + odd)).collect()]
    own = [r for r in got if r["doc_id"] is not None and 0 < r["doc_id"] < 300 and r["held_out"]]
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in own) / len(own) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] == by[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.language(docs_of(spark, [(0, "abc", None, "s")])).collect()} == {"und"}
    assert language.language(docs_of(spark, [])).collect() == []


# ---------------------------------------------------------------- language model


def test_log_probs_by_hand():
    net = lm.Network(np.array([5, 9], np.uint64))
    net.flat += np.random.default_rng(0).normal(0, 0.3, len(net.flat)).astype(np.float32)
    ids = net.tokens(np.array([5, 9, 77, 5], np.uint64))
    assert ids.tolist() == [0, 1, lm.VOCAB - lm.RARE + 77 % lm.RARE, 0]
    first = np.array([0, 3, 4])
    around = net.contexts(ids, first)
    got = net.log_probs(ids, around)
    for t, (lo, hi) in enumerate([(0, 3), (0, 3), (0, 3), (3, 4)]):
        near = [ids[j] if lo <= (j := t + k) < hi else lm.VOCAB for k in (-2, -1, 1, 2)]
        h = np.tanh(sum(net.embed[k][w] for k, w in enumerate(near)) + net.bias)
        z = net.top @ h + net.top_bias
        own = net.low[ids[t] // 64] @ h + net.low_bias[ids[t] // 64]
        want = z[ids[t] // 64] - np.log(np.exp(z).sum()) + own[ids[t] % 64] - np.log(np.exp(own).sum())
        assert got[t] == pytest.approx(float(want), abs=1e-4)
    total = sum(np.exp(net.log_probs(np.full(1, w), around[:, :1]))[0] for w in range(lm.VOCAB))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_prefers_real_order(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice(["the red cat sat", "a big dog ran", "my old car broke"]) for _ in range(30))
    rows = [(i, say(), "en", "s") for i in range(150)]
    mixed = [(1000 + i, " ".join(rng.sample(r[1].split(), len(r[1].split()))), "en", "s") for i, r in enumerate(rows[:10])]
    odd = [(2000, None, "en", "s"), (2001, " \n", "en", "s"), (None, "the red cat sat", "en", "s"), (2002, "the red cat sat " * 20_000, "en", "s")]
    net = lm.train(docs_of(spark, rows), rounds=3, stride=1)
    got = {r["doc_id"]: r for r in lm.score(docs_of(spark, rows + mixed + odd), net).collect()}
    assert all(got[1000 + i]["mean_log_prob"] < got[i]["mean_log_prob"] - 0.3 for i in range(10))
    assert (got[2000]["n_tokens"], got[2000]["log_prob"], got[2000]["mean_log_prob"]) == (0, 0.0, None) and got[2001]["n_tokens"] == 0 and got[2002]["n_tokens"] == 80_000
    assert lm.scored(docs_of(spark, [])).collect() == []


def test_every_token_is_a_target(spark, monkeypatch):
    from collections import Counter

    seen = Counter()
    monkeypatch.setattr(lm.Network, "step", lambda self, ids, *_: seen.update(ids.tolist()))
    hashes = np.arange(40, dtype=np.uint64)
    monkeypatch.setattr(lm, "texts_of", lambda column: iter([(0, 4, None, hashes, None, None, np.array([0, 1, 1, 8, 40]))]))
    batch = pa.RecordBatch.from_pydict({"text": ["", "", "", ""]})
    for turn in range(lm.ROUNDS):
        list(lm._trained(hashes, lm.Network(hashes).flat, turn, lm.STRIDE)([batch]))
    assert seen == dict.fromkeys(range(40), 1)
    with pytest.raises(ValueError):
        lm.train(docs_of(spark, []), rounds=2, stride=3)


def test_rare_words_have_their_share(spark):
    from collections import Counter

    from lodestone.llm._words import texts_of

    common = [f"w{i}" for i in range(lm.VOCAB - lm.RARE)]
    rare = [f"r{i}" for i in range(400)]
    said = common * 6 + [w for i, w in enumerate(rare) for _ in range(1 + i % 4)]
    random.Random(3).shuffle(said)
    rows = [(i, " ".join(said[i * 50 : i * 50 + 50]), "en", "s") for i in range(len(said) // 50 + 1)]
    rows += [(None, "r0 w1", "en", "s"), (1, "r0 w1", "en", "s"), (5000, None, "en", "s")]
    net = lm.train(docs_of(spark, rows))
    unseen = [(6000, "never r3 seen w7", "en", "s")]
    n = Counter(w for r in rows for w in (r[1] or "").split())
    h = {w: next(texts_of(pa.array([w])))[3] for w in [*n, "never", "seen"]}
    token = {w: int(net.tokens(x)[0]) for w, x in h.items()}
    assert all((token[w] >= lm.VOCAB - lm.RARE) == (w[0] != "w") for w in h)
    total = Counter()
    for w in n:
        total[token[w]] += n[w]

    def brute(text):
        ids = np.array([token[w] for w in text.split()], np.int64)
        p = net.log_probs(ids, net.contexts(ids, np.array([0, len(ids)])))
        return p.sum() + sum(np.log(max(n[w], 1) / (total[token[w]] + 1)) for w in text.split() if w[0] != "w")

    got = lm.score(docs_of(spark, rows + unseen), net).collect()
    assert len(got) == len(rows) + 1
    a = sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_prob"], 3)) for r in got)
    b = sorted((str(r[0]), len((r[1] or "").split()), round(float(brute(r[1])) if r[1] else 0.0, 3)) for r in rows + unseen)
    assert all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=0.01) for x, y in zip(a, b, strict=True))


def test_vocabulary_counts_all(spark):
    rows = [(i, "b b a c" if i % 2 else "a b", "en", "s") for i in range(20)]
    from lodestone.llm._words import texts_of

    h = {w: next(texts_of(pa.array([w])))[3][0] for w in "abc"}
    assert lm.vocabulary(docs_of(spark, rows)).tolist() == [h["b"], h["a"], h["c"]]


# ---------------------------------------------------------------- mixing


def targets_brute(sizes):
    """sizes: words by source, in order."""
    w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 300), "en", rng.choice(["a", "a", "a", "b", "c", "ü", None])) for i in range(600)] + [(9000, "w", "en", "tiny"), (9001, None, "en", "a"), (9002, "", "en", "void"), (None, "w w", "en", "b"), (5, "w " * 40, "en", "b"), (5, "w " * 40, "en", "b")]
    d = docs_of(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mixing.mix(d).collect()), key=str) == sorted(map(tuple, got), key=str)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in names]
    want = dict(zip(names, targets_brute(sizes), strict=True))
    source = {}
    for r in rows:
        source.setdefault((r[0], len(words(r[1]))), r[3])
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[names.index(s)] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_rates_are_tilted_exponentially(spark):
    counts = spark.createDataFrame([(0, s, 5) for s in range(1, 40)], "place int, size long, n long")
    words_ = sum(5 * s for s in range(1, 40))
    src = spark.createDataFrame([("a", words_, 195, 0, words_ * 0.6)], "source string, words long, n long, place int, target double")
    r = mixing.duals(counts, src).first()
    got = sum(5 * s * min(3.0, np.exp(r["dual"] * s / r["mean"])) for s in range(1, 40))
    assert got == pytest.approx(words_ * 0.6, rel=1e-6) and r["dual"] < 0


# ---------------------------------------------------------------- archives


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\n", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "http://b", None, "c"), (4, "http://b", "", "c"), (5, "é", "ü\r\n\r\nWARC/1.1\r\n", "c"), (None, "n", "<p>x</p>", "c"), (6, "long", "y" * 3_000_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r["id"]: r for r in warc.read_records(index).collect()}
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    for i, url, html, _ in rows:
        r = got[i]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len((html or "").encode()), sha(html))
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    one = warc.read_records(index.where("id = 5")).first()
    assert one["payload_bytes"] == len("ü\r\n\r\nWARC/1.1\r\n".encode())
    apart = warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/v", least=1)).where("id in (3, 4)").collect()
    assert {r["record_type"] for r in apart} == {"response"}
    assert warc.archived(pages.limit(0), f"file://{tmp_path}/e").collect() == []


def test_damaged_record_is_refused(spark, tmp_path):
    raw = warc.record(1, "u", b"abc", warc.payload_digest(b"abd"), None, False)
    import gzip

    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), pa.array([f"file://{tmp_path}/x.warc.gz"]), pa.array([0]), pa.array([len(gzip.compress(raw))])], ["id", "url", "file", "at", "length"])
    with pytest.raises(ValueError, match="digest"):
        list(warc._reader([batch]))


# ---------------------------------------------------------------- decontamination


def leaks_brute(rows, items):
    out = {}
    for d, text, *_ in rows:
        w = words((text or "").lower())
        for item, body in items:
            v = words((body or "").lower())
            if not v:
                continue
            k = min(5, len(v))
            grams = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
            bag = grams(v)
            for s in range(len(w) - len(v) + 1):
                seen = grams(w[s : s + len(v)])
                both = sum(min(seen.count(g), bag.count(g)) for g in set(seen))
                sim = both / (2 * len(bag) - both)
                if 10 * both >= 8 * (2 * len(bag) - both) and (sim, -s) > out.get((d, item), (0, 0)):
                    out[(d, item)] = (sim, -s)
    return sorted((d, i, -s, pytest.approx(sim)) for (d, i), (sim, s) in out.items())


def test_leaks(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate([12, 20, 33, 60])] + [(10, "Tiny item"), (11, None), (12, ""), (13, "go go go go go go go go")]
    rows = [(i, prose(80), "en", "s") for i in range(10)]
    for j, (_, body) in enumerate(items[:4]):
        edited = body.split()
        edited[-1] = "edited"
        rows += [(100 + j, f"{prose(15)} {body.upper()} {prose(9)} {body}", "en", "s"), (200 + j, f"{prose(7)}\n{' '.join(edited)} {prose(3)}", "en", "s"), (300 + j, " ".join(body.split()[: len(body.split()) // 2]), "en", "s"), (400 + j, body, "en", "s"), (500 + j, prose(5) + " " + " ".join(body.split()[1:] + ["x"]), "en", "s")]
    rows += [(600, "a tiny item here", "en", "s"), (601, None, "en", "s"), (602, "  ", "en", "s"), (603, "go " * 30, "en", "s"), (604, "x " * 20_000 + items[0][1], "en", "s")]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, k int")
    d = docs_of(spark, rows + [rows[10]] * 3)
    got = sorted(set(map(tuple, decontamination.leaks(d, bench).collect())))
    want = leaks_brute(rows, items)
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want
    left = decontamination.decontaminated(d, bench)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {w[0] for w in want}
    assert decontamination.leaks(d, bench.limit(0)).collect() == [] and decontamination.decontaminated(d, bench.limit(0)).count() == len(rows) + 3
    assert decontamination.leaks(docs_of(spark, []), bench).collect() == []


def test_blocks_meet_within_the_radius():
    rng = random.Random(1)
    cuts = [round(i * 64 / (decontamination.RADIUS + 1)) for i in range(decontamination.RADIUS + 2)]
    assert cuts[0] == 0 and cuts[-1] == 64 and len(set(cuts)) == len(cuts)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontamination.RADIUS):
            y ^= 1 << b
        assert any((x >> a) & ((1 << (b - a)) - 1) == (y >> a) & ((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False))


# ---------------------------------------------------------------- urls


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    import re

    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = lower(m[1]), m[2]
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    return host, path, max(fit, key=lambda r: len(r.name)) if fit else None


LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def rank_brute(links, seeds, rounds=url_filter.ROUNDS, damping=url_filter.DAMPING):
    total = {}
    for (s, _), n in links.items():
        total[s] = total.get(s, 0) + n
    rank = dict(seeds)
    for _ in range(rounds):
        lost = sum(r for h, r in rank.items() if h not in total)
        new = {h: (1 - damping + damping * lost) * w for h, w in seeds.items()}
        for (s, d), n in links.items():
            if s in rank:
                new[d] = new.get(d, 0) + damping * rank[s] * n / total[s]
        rank = new
    return rank


def test_url_filter(spark):
    a = lambda *x: "".join(f'<a href="http://{h}/p">x</a>' for h in x)
    pages = [
        (1, "http://a.net/x", a("bad.info", "bad.info")), (2, "http://b.example.net/en/1", a("good.info", "mid.info")), (3, "https://WWW.Example.com/de/?q", a("worse.info")), (4, "http://x.org/fr/", a("mid.info", "good.info", "x.org")),
        (5, "http://mid.info/1", a("bad.info")), (6, "http://bad.info/", a("a.net", "evil.net")), (7, "http://good.info", None), (8, None, a("a.net")), (9, "no scheme", None), (10, "ftp://host?x#y", "<a HREF='HTTP://A.NET/'>"),
        (11, "http://example.net/en", ""), (12, "http://notnet/", ""), (13, "http://worse.info/#f", a("shop.example.com", "evil.net")), (1, "http://a.net/x", a("bad.info")), (14, "http://example.net/en/\nfoo", ""), (15, "http://", ""), (None, "http://net/", None),
        (16, "http://plain.info/", '<a href="//bad.info/x">x</a>'), (17, "http://spaced.info/", "<a href=' https://bad.info/y'>x</a> <a href='path//none.info'>"), (18, "http://dead.info/", ""), (19, "http://b.example.net/en/2", a("dead.info")),
    ]
    d = spark.createDataFrame([(*p, "h", 0.5) for p in pages], "page_id long, url string, html string, host string, rank double")
    got = url_filter.url_filter(d).collect()
    import re

    links = {}
    for _, url, html in pages:
        s = judge(url)[0]
        for t in re.findall(LINK, html or ""):
            if s and lower(t) != s:
                links[(s, lower(t))] = links.get((s, lower(t)), 0) + 1
    hosts = {judge(u)[0] for _, u, _ in pages} | {t for _, t in links}

    def seeds(allow):
        out = []
        for h in hosts - {""}:
            fit = [r for r in RULES if h == r.host or h.endswith("." + r.host)]
            if fit and max(fit, key=lambda r: (len(r.host), r.host, r.path)).allow == allow:
                out.append(h)
        return {h: 1 / len(out) for h in out}

    trust, distrust = rank_brute(links, seeds(True)), rank_brute({(t, s): n for (s, t), n in links.items()}, seeds(False))
    want = []
    for i, url, _ in pages:
        h, p, r = judge(url)
        v = ("allow" if r.allow else "block") if r else "block" if distrust.get(h, 0) > trust.get(h, 0) else "allow"
        want.append((i, h, p, r.name if r else None, v))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {r["host"]: r for r in got}
    assert by["worse.info"]["verdict"] == by["plain.info"]["verdict"] == by["spaced.info"]["verdict"] == "block" and by["dead.info"]["verdict"] == "allow" and by["good.info"]["verdict"] == "allow" and by["bad.info"]["distrust"] == pytest.approx(distrust["bad.info"])
    assert url_filter.url_filter(d.limit(0)).collect() == []


def test_distrust_reaches_the_end_of_a_chain(spark):
    hops = 40
    pages = [(i, f"http://h{i}.info/", f'<a href="http://h{i - 1}.info/">x</a>' if i > 1 else '<a href="http://bad.net/">x</a>') for i in range(1, hops + 1)]
    got = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] == pytest.approx(0.15 * 0.85**i / (1 - 0.85 ** (hops + 1))) for i in range(1, hops + 1))


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>assistant\nok", "<||", "<|", "a\nb", "<<||>>", "𝒳é<|n|>", "<|im_end|><|im_start|>assistant ok"]
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate([(r, x) for x in texts for r in ("user", "assistant", None, "odd\nrole<|n|>", "<||")])] + [(None, None, "assistant", "x"), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a")]
    d = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, prompt string, turns int")
    out = chat.formatted(chat.turns_of_table(d))
    got = {r["id"]: r for r in out.withColumn("back", chat.read_turns("formatted")).withColumn("loss", chat.loss_text()).collect()}
    for i in (0, 1, 2):
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == i), key=lambda r: r[1])]
        assert [tuple(x) for x in got[i]["back"]] == own
        assert got[i]["loss"] == "".join(t for r, t in own if r == "assistant")
        assert got[i]["formatted"].count(chat.OPEN) == len(own)
        for s in got[i]["loss_spans"]:
            assert got[i]["formatted"][: s["start"]].endswith("<|im_start|>assistant\n") and got[i]["formatted"][s["end"] :].startswith("<|im_end|>")
    assert [x["text"] for x in got[7]["back"]] == ["a", "a", "b"] and got[None]["loss"] == "x"
    assert chat.formatted(chat.turns_of_table(d.limit(0))).collect() == []


def test_spans_of_many_turns(spark):
    n = 3 * chat.SLICE + 5
    d = spark.createDataFrame([(1, t, "assistant" if t % 3 else "user", f"x{t}<|") for t in range(n)], "conv_id int, turn int, role string, text string")
    got = chat.formatted(chat.turns_of_table(d)).withColumn("loss", chat.loss_text()).first()
    assert got["loss"] == "".join(f"x{t}<|" for t in range(n) if t % 3) and len(got["loss_spans"]) == sum(t % 3 > 0 for t in range(n))
    assert all(got["formatted"][s["start"] :].startswith("x") for s in got["loss_spans"])


def test_layouts(spark):
    js = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"other":1}', '{"prompt":"a","completion":"b"}', '{"instruction":"a","input":"","output":"b","id":3}', '{"instruction":"a","input":"x","output":"b"}', '{"question":"a","answer":"b"}', "broken", None, '{"odd":1}', '{"prompt":"a","completion":"b","system":"s"}']
    got = {r["id"]: r for r in chat.turns_of_json(spark.createDataFrame(list(enumerate(js)), "i int, j string"), "i", "j").collect()}
    plain = [("user", "a"), ("assistant", "b")]
    turns = lambda i: None if got[i]["turns"] is None else [tuple(x) for x in got[i]["turns"]]
    assert all(turns(i) == plain for i in (0, 1, 2, 3, 5, 9)) and turns(4) == [("user", "a\n\nx"), ("assistant", "b")] and turns(6) is None and turns(7) is None and turns(8) is None
    assert got[0]["fingerprint"] == chat.fingerprint(["messages[].role", "messages[].content"]) and got[2]["layout"] == "prompt completion"
    table = spark.createDataFrame([(1, "a", "b", "x")], "id int, instruction string, output string, text string")
    assert [tuple(x) for x in chat.turns_of_table(table, "id").first()["turns"]] == plain
    with pytest.raises(ValueError):
        chat.layout_of(table.select("id").schema)


def test_records_with_nulls_keep_their_layout(spark):
    js = ['{"instruction":"a","output":null}', '{"prompt":"","completion":null}', '{"messages":[{"role":"user","content":null},{"role":"Assistant","content":"b"}]}', '{"messages":[]}', '{"messages":[{"role":"user"},{"role":"assistant","content":"b"}]}', '{"messages":null}', '{"conversations":[{"from":"Human","value":"a"},{"from":"GPT","value":null}],"system":"s"}']
    got = {r["id"]: r for r in chat.turns_of_json(spark.createDataFrame(list(enumerate(js)), "i int, j string"), "i", "j").collect()}
    turns = [[tuple(x) for x in got[i]["turns"]] for i in range(len(js))]
    assert turns[0] == [("user", "a"), ("assistant", None)] and turns[1] == [("user", ""), ("assistant", None)]
    assert turns[2] == turns[4] == [("user", None), ("assistant", "b")] and turns[3] == turns[5] == []
    assert turns[6] == [("system", "s"), ("user", "a"), ("assistant", None)] and got[3]["layout"] == "messages"
    out = chat.formatted(spark.createDataFrame([(1, [("user", None), ("assistant", "b")])], "id int, turns array<struct<role:string,text:string>>")).withColumn("loss", chat.loss_text()).first()
    assert out["loss"] == "b"


def test_records_that_are_hard_to_read(spark):
    js = [
        '{"prompt":"a","completion":"b","prompt":"c"}', '{"messages":"hi"}', '{"messages":[{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image"},{"type":"text","text":" you"}]},{"role":"assistant","content":["x","y"]}]}',
        '{"messages":[null,{"role":"user","content":"a"}]}', '{"prompt":{"x":1},"completion":"b"}', '{"prompt":7,"completion":true}', '{"messages":["a"]}', '{"messages":[{"role":"user","content":"a"}],"messages":[{"role":"user","content":"b"}]}',
        '{"messages":[{"role":"user","content":{"text":"a"}}]}', '{"prompt":["a","b"],"completion":"[c]"}', '{"conversations":{"from":"human","value":"a"}}', '[{"prompt":"a"}]', '{"prompt":"a","prompt":null,"completion":"b"}',
    ]
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(x) for x in r["turns"]]) for r in chat.turns_of_json(spark.createDataFrame(list(enumerate(js)), "i int, j string"), "i", "j").collect()}
    pair = lambda a, b: ("prompt completion", [("user", a), ("assistant", b)])
    assert got[0] == pair("c", "b") and got[5] == pair("7", "true") and got[9] == pair("ab", "[c]") and got[12] == pair(None, "b")
    assert got[2] == ("messages", [("user", "hi you"), ("assistant", "xy")]) and got[7] == ("messages", [("user", "b")])
    assert all(got[i] == (None, None) for i in (1, 3, 4, 6, 8, 10, 11)), got


def test_words_and_pieces_of_any_script():
    from lodestone.llm import _letters

    text = "Привет—МИР。你好，世界 naïve x1y ok हिन्दी"
    *_, points, h, start, end, first = next(_letters.words_of(pa.array([text])))
    assert [text[i:j].lower() for i, j in zip(start, end, strict=True)] == ["привет", "мир", "你好", "世界", "naïve", "x", "y", "ok", "हिन्दी"] and first.tolist() == [0, 9]
    again = next(_letters.words_of(pa.array([text.lower()])))[3]
    assert (again == h).all()
    g, word = _letters.pieces(points, start[:1], end[:1], 3)
    assert len(g) == 4 and word.tolist() == [0] * 4
    assert [len(next(_letters.words_of(pa.array(["1d10t idiot"]), digits=True))[3]), len(next(_letters.words_of(pa.array(["1d10t idiot"])))[3])] == [2, 3]
    joined = list(_letters.words_of(pa.array(["ab cd " * 200_000]), whole=True))
    assert len(joined) == 1 and joined[0][-1].tolist() == [0, 400_000] and (joined[0][3][::2] == joined[0][3][0]).all()
    long = pa.array(["é" * 3_000_000 + " " + "ab cd " * 200_000])
    n = sum(int(x[-1][-1]) for x in _letters.words_of(long))
    assert 400_000 < n < 400_020


def test_language_by_hand():
    """Scores against a plain version: log frequency of a known word, else the mean over the longest known pieces."""
    from collections import Counter

    texts, langs = ["aba aba cab", "xyz aba xyz"], ["p", "q"]
    m = language.fit(pa.array(texts), langs)
    counts = [Counter(), *[Counter() for _ in language.LENGTHS]]
    for t, lang in zip(texts, langs, strict=True):
        for w in t.split():
            counts[0][w, lang] += 1
            for k, n in enumerate(language.LENGTHS, 1):
                for i in range(len(w) - n + 1):
                    counts[k][w[i : i + n], lang] += 1
    known = [{x for x, _ in c} for c in counts]
    totals = [{lang: sum(v for (_, y), v in c.items() if y == lang) + 1 for lang in "pq"} for c in counts]
    known[0] = {w for w in known[0] if counts[0][w, "p"] + counts[0][w, "q"] > 1}
    totals[0] = {lang: sum(counts[0][w, lang] for w in known[0]) + 1 for lang in "pq"}

    def logs(k, x, lang):
        share = (counts[k][x, "p"] + counts[k][x, "q"] + 1) / sum(totals[k].values())
        return np.log((counts[k][x, lang] + 2 * share) / (totals[k][lang] + 2))

    def word(w, lang):
        if w in known[0]:
            return logs(0, w, lang)
        for k, n in enumerate(language.LENGTHS, 1):
            if hit := [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] in known[k]]:
                return np.mean([logs(k, x, lang) for x in hit])
        return 0.0

    asked = ["aba xyzz cabx", "", "q abacab"]
    got = m.scores(pa.array(asked))
    assert got == pytest.approx(np.array([[sum(word(w, lang) for w in t.split()) for lang in "pq"] for t in asked]), abs=1e-4)


def test_toxicity_by_hand():
    """Logits against a plain version: mean over the subwords of a word, then over the words of the worst window."""
    rows, labels = corpus(60)
    m = toxicity.fit(pa.array([r[1] for r in rows]), np.array([x[2] for x in labels]), rounds=6)

    def word(w):
        points, h, start, end = next(toxicity.words_of(pa.array([w]), True, True))[2:6]
        ids, _ = toxicity.subwords(points, h, start, end)
        return float(np.mean(m.table[ids].astype(float)))

    def logit(text):
        v = [word(w) for w in text.split()]
        at = range(0, max(len(v) - toxicity.WIDTH, 0) + toxicity.STRIDE, toxicity.STRIDE)
        return max(np.mean(v[i : i + toxicity.WIDTH]) for i in at if v[i : i + toxicity.WIDTH]) + m.bias

    texts = [r[1] for r in rows[:12]] + ["stupid", "thing er " * 9]
    assert m.logits(pa.array(texts)) == pytest.approx(np.array([logit(t) for t in texts]), abs=1e-4)


def test_column_functions_need_no_python(spark):
    d = docs_of(spark, [(1, "a b c d e f", "en", "s")])
    out = chat.formatted(chat.turns_of_table(spark.createDataFrame([(1, 1, "user", "x")], "conv_id int, turn int, role string, text string")))
    plan = out._jdf.queryExecution().toString() + d.select(decontamination.fingerprint("array(1L)"), F.lit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
