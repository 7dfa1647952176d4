"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike to 80 % and more.

Method: a prefix-tree join. All sets share one global order (rarer shingles first, then by hash).
Two sets that are alike enough share a shingle among the first n - ceil(0.8 n) + 1 of each, so only
sets that meet there are compared. The comparison stores the ordered sets of a group in a trie whose
edges hold runs of shingles, walks it level by level so that sets with a common beginning share one
partial overlap, and leaves a subtree once the overlap and what remains on either side can't reach the
threshold. It yields exact overlaps; nothing is dropped, sampled or capped.

Steps, all in Spark:

1. Equal word sequences collapse to one set, named by a 128-bit digest of the words themselves.
2. A part of the hash range of all shingles is dealt by shingle, at most two rows for each shingle of a run of some million;
   a set with so many shingles of its own (held by no other set) that it can have no partner falls out.
3. The sets left are dealt into chunks of bounded size. A chunk sends each distinct shingle once, with the number of
   its sets that hold it, and gets back how many sets hold it in all, so that a shingle in a third of all sets is no larger
   than another. That gives the order and each set's prefix.
4. Sets that meet in a prefix are compared to one leader of the shingle each, then, where components meet in very many pairs, for a few turns one pair for each
   component, and at last every set with every other of another component that it meets where that can be their
   first shared shingle (with a large component as a whole, block by block). Rows of a shingle in many sets are dealt by
   (shingle, salt), so that a task gets about HOT of them, and every pair of salts still meets.

Results for odd input: null, empty or blank text has no shingles and is linked with nothing; a text of
fewer than five words is one shingle; repeated rows each get their row; a null id is never the least
one, and a component of null ids alone has a null id; ids of any type; other columns, whatever their names, are ignored.
Shingles are compared as 64-bit hashes of their words: two sets of 10 000 shingles count one too many in about one of 10^11 pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._blocks import tidied
from ._graph import components
from ._store import TASK_ROWS, fresh, joined_by_size, sized, written
from ._words import buffers, grams, groups, hashed

#: Part of the hash range whose shingles are dealt to count sets; more only where a prefix needs more.
LOW_SHARE = 0.4
LOW = np.uint64(int(LOW_SHARE * 2**64))
#: Bits of the filter that picks the texts of candidates: FILTER_EACH for each, in a power of two up to MOST_BITS (32 MB); chunks then leave out what it lets through.
FILTER_EACH, MOST_BITS = 16, 1 << 28
#: Shingles that a task holds before it sends them; shingles of a chunk of sets on average.
RUN_SHINGLES, CHUNK_SHINGLES = 2_000_000, 250_000
#: Sets that one task compares with a leader; rows of one shingle that are dealt together.
SALT_ROWS, HOT = 128, 4096
RUN = 64
#: Sets in a row that link no other, after which a group's search around its leader ends; turns of leaders across components.
PROBES, TURNS = 8, 4
#: Pairs for each prefix row that components may have between them before a turn of leaders goes ahead.
PAIRS_EACH = 64
#: Sets of a component from which on others are compared with its blocks of about SALT_ROWS sets, not dealt as pairs.
LARGE = 64
#: Bytes of a text that are digested at a time.
PIECE = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def prefix(n):
    """Length of the probing prefix of a set of n: n - ceil(4 n / 5) + 1."""
    return n - (4 * n + 4) // 5 + 1


def needed(a, b):
    """Least overlap of sets of a and b with 100 * overlap >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def sequence_digest(raw: bytes) -> bytes:
    """128 bits of the words of a text, A-Z as a-z, each with one space behind it."""
    out, i = blake2b(digest_size=16), 0
    while i < len(raw):
        j = min(len(raw), i + PIECE)
        if j < len(raw):
            gap = _GAP.search(raw, j)
            j = gap.start() if gap else len(raw)
        if words := raw[i:j].lower().split():
            out.update(b" ".join(words) + b" ")
        i = j
    return out.digest()


def _short(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "little", signed=True)


def _distinct(words: np.ndarray) -> np.ndarray:
    g = grams(words)
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g


def _each(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """The index, bytes and word hashes of each text."""
    raw, at = buffers(texts)
    for i, j in groups(raw, at):
        part = raw[at[i] : at[j]]
        h, _, _, first = hashed(part, at[i : j + 1] - at[i])
        for k in range(j - i):
            yield i + k, part[at[i + k] - at[i] : at[i + k + 1] - at[i]].tobytes(), h[first[k] : first[k + 1]]


IDS = "n long, low long, sent long, sid binary, s long"


def _ids(batches):
    for b in batches:
        n, low, sent, sids = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
        for k, raw, words in _each(b.column("text")):
            g = _distinct(words)
            n[k], low[k] = len(g), np.searchsorted(g, LOW)
            sent[k], sids[k] = _sent(g), sequence_digest(raw)
        yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (n, low, sent)), pa.array(sids, pa.binary()), pa.array([_short(x) for x in sids], pa.int64())], ["id", "n", "low", "sent", "sid", "s"])


def _sent(g: np.ndarray) -> int:
    """How many of a sorted set's shingles are dealt to find candidates."""
    return max(int(np.searchsorted(g, LOW)), min(len(g), prefix(len(g))))


def _unseen(texts: pa.Array, seen: set[bytes], wanted=lambda sid: True) -> tuple[list[bytes], pa.Array]:
    """The digests that are new to seen and wanted, and their texts."""
    texts = texts.cast(pa.large_binary())
    sids, at = [], []
    for k, x in enumerate(texts):
        sid = sequence_digest(x.as_py() or b"")
        if sid not in seen and wanted(sid):
            seen.add(sid)
            sids.append(sid)
            at.append(k)
    return sids, texts.take(pa.array(at, pa.int64()))


def _ends(tokens: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
    """For each token its least and its largest set, which are one row where they are the same."""
    order = np.lexsort((sets, tokens))
    t, s = tokens[order], sets[order]
    first = np.concatenate(([True], t[1:] != t[:-1]))
    keep = first | np.append(first[1:], True)
    return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(s[keep])], ["token", "s"])


def _dealt(batches):
    """(token, set): for each run of shingles, the ends of each."""
    seen: set[bytes] = set()
    tokens, sets, held = [], [], 0
    for b in batches:
        sids, texts = _unseen(b.column("text"), seen)
        for k, _, words in _each(texts):
            g = _distinct(words)
            g = g[: _sent(g)]
            tokens.append(g)
            sets.append(np.full(len(g), _short(sids[k]), np.int64))
            held += len(g)
            if held >= RUN_SHINGLES:
                yield _ends(np.concatenate(tokens), np.concatenate(sets))
                tokens, sets, held = [], [], 0
    if held:
        yield _ends(np.concatenate(tokens), np.concatenate(sets))


def candidates(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(s, n) of the sets that may have a partner: by the shingles dealt they hold few enough alone, and some with others."""
    ends = docs.select("text").mapInArrow(tidied(_dealt), "token long, s long").groupBy("token").agg(F.min("s").alias("s"), F.max("s").alias("other"))
    alone = ends.where("s = other").groupBy("s").agg(F.count(F.lit(1)).alias("alone"), F.count_if(F.expr(f"token >= 0 and token < {int(LOW)}L")).alias("alone_low"))
    # two sequences with the same 64 bits both stay: their counts are one
    keys = ids.where("n > 0").groupBy("s").agg(F.min("sid").alias("x"), F.max("sid").alias("y"), F.sum("n").alias("of_copies"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sent").alias("sent"))
    known = keys.join(alone, "s", "left").fillna(0, ["alone", "alone_low"])
    return known.where("x <> y or (alone < sent and alone_low < n - (4 * n + 4) div 5 + 1)").select("s", F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(F.col("of_copies")).alias("n"))


def _filter_bits(keys: DataFrame, size: int) -> np.ndarray:
    """A bit for each value of s; size / 64 rows at most reach the driver."""
    rows = keys.groupBy(F.expr(f"cast(pmod(s, {size}) div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) as int)))").alias("x")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows["w"].to_numpy()] = rows["x"].to_numpy()
    return bits


def _picked(shared, chunks: int):
    """(chunk, s, sid, shingles) of texts that the filter lets through, each once in a task."""

    def run(batches):
        bits, seen = shared.value, set()
        size = 64 * len(bits)

        def wanted(sid):
            s = _short(sid)
            return bool((int(bits[(s % size) // 64]) >> (s % 64)) & 1)

        for b in batches:
            sids, texts = _unseen(b.column("text"), seen, wanted)
            rows, held = [], 0
            for k, _, words in _each(texts):
                if not len(words):
                    continue
                rows.append((sids[k], _distinct(words).tobytes()))
                held += len(rows[-1][1])
                if held > 1 << 23:
                    yield _set_rows(rows, chunks)
                    rows, held = [], 0
            if rows:
                yield _set_rows(rows, chunks)

    return run


def _set_rows(rows, chunks: int) -> pa.RecordBatch:
    s = [_short(x[0]) for x in rows]
    return pa.RecordBatch.from_arrays([pa.array([x % chunks for x in s], pa.int32()), pa.array([1] * len(rows), pa.int32()), pa.array(s, pa.int64()), pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], ["chunk", "kind", "s", "sid", "shingles"])


PICKED, SETS = "chunk int, kind int, s long, sid binary, shingles binary", "chunk int, v long, sid binary, shingles binary"


def _numbered(batches):
    """Rows sorted by (chunk, kind, sid): candidates, then sets. Each candidate's set once, numbered within its chunk."""
    chunk, wanted, last, at = None, set(), None, 0
    for b in batches:
        rows = []
        for i, (c, kind, s) in enumerate(zip(*(b.column(x).to_pylist() for x in ("chunk", "kind", "s")), strict=True)):
            if c != chunk:
                chunk, wanted, last, at = c, set(), None, 0
            if not kind:
                wanted.add(s)
                continue
            sid = b.column("sid")[i].as_py()
            if sid != last and s in wanted:
                rows.append((c, (c << 32) + at, i))
                last, at = sid, at + 1
        if rows:
            pick = pa.array([x[2] for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), b.column("sid").take(pick), b.column("shingles").take(pick)], ["chunk", "v", "sid", "shingles"])


def candidate_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk, v, sid, shingles) of the candidates (s, n), each set once; v numbers them."""
    known = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = min(MOST_BITS, 1 << max(16, (FILTER_EACH * known[0]).bit_length()))
    chunks = known[1] // CHUNK_SHINGLES + 1
    sets = docs.select("text").mapInArrow(tidied(_picked(docs.sparkSession.sparkContext.broadcast(_filter_bits(keys, size)), chunks)), PICKED)
    wanted = keys.select(F.expr(f"cast(pmod(s, {chunks}) as int)").alias("chunk"), F.lit(0).alias("kind"), "s", F.lit(None).cast("binary").alias("sid"), F.lit(None).cast("binary").alias("shingles"))
    return written(wanted.unionAll(sets).repartition("chunk").sortWithinPartitions("chunk", "kind", "sid").mapInArrow(tidied(_numbered), SETS), "sets")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if len(keys) else []


def _flat(shingles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of some sets, and the size of each."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles]
    return np.concatenate(sets), np.array([len(x) for x in sets])


def _counts(batches):
    """(chunk, token, n): how many sets of a chunk hold a token, a row for each batch."""
    for b in batches:
        chunk = b.column("chunk").to_numpy()
        for i, j in _runs(chunk):
            t, n = np.unique(_flat(b.column("shingles").slice(i, j - i))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), chunk[i])), pa.array(t.view(np.int64)), pa.array(n)], ["chunk", "token", "n"])


PREFIXES = "token long, v long, n int, lone int, at int, held long"


def _prefixes(batches):
    """Rows sorted by (chunk, kind): (token, sets that hold it) of shared tokens, then sets. The shared ones in each set's prefix: (token, set, size, lone tokens, place in the order, sets that hold it)."""
    chunk, parts, known = None, [], None
    for b in batches:
        kinds = b.column("kind").to_numpy()
        key = b.column("chunk").to_numpy() * np.int64(2) + kinds
        for i, j in _runs(key):
            if key[i] // 2 != chunk:
                chunk, parts, known = key[i] // 2, [], None
            if not kinds[i]:
                parts.append((b.column("token").slice(i, j - i).to_numpy().view(np.uint64), b.column("held").slice(i, j - i).to_numpy()))
                continue
            if known is None:
                t, held = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                t, at = np.unique(t, return_index=True)
                known, parts = (t, held[at]), []
            for k in range(i, j, 256):
                if len(known[0]) and len(out := _prefix_rows(*known, b.slice(k, min(256, j - k)))):
                    yield out


def _prefix_rows(shared: np.ndarray, many: np.ndarray, sets: pa.RecordBatch) -> pa.RecordBatch:
    t, size = _flat(sets.column("shingles"))
    which = np.repeat(np.arange(len(size)), size)
    at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
    hit = shared[at] == t
    lone = size - np.bincount(which, hit, len(size)).astype(np.int64)
    t, which, held = t[hit], which[hit], many[at[hit]]
    order = np.lexsort((t, held, which))
    t, which, held = t[order], which[order], held[order]
    place = lone[which] + np.arange(len(which)) - np.searchsorted(which, which)
    keep = place < prefix(size[which])
    t, which, held, place = t[keep], which[keep], held[keep], place[keep]
    v = sets.column("v").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(v[which]), pa.array(size[which].astype(np.int32)), pa.array(lone[which].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(held)], ["token", "v", "n", "lone", "at", "held"])


def prefixes_of(sets: DataFrame) -> DataFrame:
    """PREFIXES of candidate_sets: what each set's prefix shares with other sets."""
    counts = sets.select("chunk", "shingles").mapInArrow(tidied(_counts), "chunk int, token long, n long")
    held = counts.withColumn("held", F.sum("n").over(Window.partitionBy("token"))).where("held > 1")  # at most a row for each batch of sets
    answers = held.select("chunk", F.lit(0).alias("kind"), "token", "held", F.lit(None).cast("long").alias("v"), F.lit(None).cast("binary").alias("shingles"))
    asked = sets.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("token"), F.lit(None).cast("long").alias("held"), "v", "shingles")
    return written(answers.unionAll(asked).repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(tidied(_prefixes), PREFIXES), "prefixes")


def trie_overlaps(probe: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of probe with each of the ordered sets, -1 where it can't reach needed().

    The sets form a trie with edges of RUN shingles; equal edges below the same node are met once.
    """
    size = np.array([len(x) for x in sets])
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    least = needed(size, len(probe))
    over, node, alive, depth = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.uint64), np.flatnonzero(np.minimum(size, len(probe)) >= least), 0
    done = np.full(len(sets), -1)
    step = np.arange(RUN)
    while len(alive):
        rest = size[alive] - depth
        inside = step < rest[:, None]
        edge = np.where(inside, flat[np.where(inside, start[alive, None] + depth + step, 0)], np.uint64(0))
        key = np.ascontiguousarray(np.concatenate([node[alive, None], np.minimum(rest, RUN).astype(np.uint64)[:, None], edge], axis=1)).view(np.dtype((np.void, 8 * (RUN + 2)))).ravel()
        _, some, which = np.unique(key, return_index=True, return_inverse=True)
        shared, real = edge[some], inside[some]
        at = np.searchsorted(probe, shared)
        hits = ((at < len(probe)) & (probe[np.minimum(at, len(probe) - 1)] == shared) & real).sum(1)
        last = shared[np.arange(len(some)), real.sum(1) - 1]
        ahead = len(probe) - np.searchsorted(probe, last, "right")
        node[alive], depth = which.astype(np.uint64), depth + RUN
        over[alive] += hits[which]
        rest = np.maximum(size[alive] - depth, 0)
        can = over[alive] + np.minimum(rest, ahead[which]) >= least[alive]
        ended = can & (rest == 0)
        done[alive[ended]] = over[alive[ended]]
        alive = alive[can & (rest > 0)]
    return done


def linked(lead: int, probe: np.ndarray, ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Linked pairs that join sets to lead, directly or by each other; it stops after PROBES sets in a row that link no other."""
    pairs, rest, queue, misses = [], list(range(len(sets))), [(lead, probe)], 0
    while rest and misses < PROBES and (queue or len(rest) > 1):
        if not queue:
            k = rest.pop(0)
            queue.append((ids[k], sets[k]))
        name, p = queue.pop(0)
        over = trie_overlaps(p, [sets[i] for i in rest])
        hit = [i for i, x in zip(rest, over.tolist(), strict=True) if x >= 0]
        rest = [i for i, x in zip(rest, over.tolist(), strict=True) if x < 0]
        pairs += [(ids[i], name) for i in hit]
        queue += [(ids[i], sets[i]) for i in hit]
        misses = 0 if hit else misses + 1
    return pairs


def _compared(batches):
    """Rows sorted by (b, salt, member): the leader's set, then its members' sets; yields linked pairs."""
    lead, salt, probe, ids, sets = None, None, None, [], []

    def out():
        got = linked(lead, probe, ids, sets)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    for batch in batches:
        for b, part, member, a, x in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "member", "a", "shingles")), strict=True):
            if member and (b, part) != (lead, salt):
                raise ValueError("a group of sets came without its leader")
            if not member or len(ids) >= SALT_ROWS:
                if ids:
                    yield out()
                ids, sets = [], []
            x = np.frombuffer(x, np.uint64)
            if not member:
                lead, salt, probe = b, part, x
            else:
                ids.append(a)
                sets.append(x)
    if ids:
        yield out()


def _needed(a: str, b: str) -> str:
    return f"(4 * ({a} + {b}) + 8) div 9"


#: How much of a set is lone, in hundredths of a percent; a leader has little of it.
_RATIO = "lone * 10000L div n"
#: Whether sets of n and of `o`, with so many shingles that no other set has, can overlap enough.
_REACH = f"{_needed('n', 'o.n')} <= least(n - lone, o.n - o.lone)"


def _met(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows (token, v, held, ...) with what tokens (token, held, o: a struct) has for their token, dealt by (token, salt)."""
    rows = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(v), held div {HOT} + 1) as int)"))
    tokens = tokens.select("token", F.explode(F.expr(f"sequence(0, cast(held div {HOT} as int))")).alias("salt"), "o")
    return rows.join(tokens, ["token", "salt"])


def led(prefixes: DataFrame) -> DataFrame:
    """(a, b): for each set the leader that it shares most of its prefix with, of the leaders of its tokens."""
    leads = prefixes.groupBy("token").agg(F.max("held").alias("held"), F.min(F.struct(F.expr(_RATIO).alias("ratio"), "v", "n", "lone")).alias("o"))
    pairs = _met(prefixes, leads).where(f"v <> o.v and {_REACH}").groupBy(F.col("v").alias("a"), F.col("o.v").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("a").agg(F.max(F.struct("c", "b")).alias("x")).select("a", "x.b")


def led_across(mixed: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each component its best pair with the leaders, drawn anew each turn, of its tokens that lie in another."""
    lead = F.struct(F.xxhash64("label", "token", F.lit(turn)).alias("rank"), F.expr(_RATIO).alias("ratio"), "v", "n", "lone", "label")
    leads = mixed.groupBy("token").agg(F.max("held").alias("held"), F.min(lead).alias("o"))
    pairs = _met(mixed, leads).where(f"label <> o.label and {_REACH}").groupBy("label", F.col("v").alias("a"), F.col("o.v").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return pairs.groupBy("label").agg(F.max(F.struct("c", "a", "b")).alias("x")).select("x.a", "x.b")


def mixed_tokens(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """PREFIXES with label and size of each set's component, of the tokens that several components have."""
    labels = sized(labels, labels.count())
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    marked = rows.select(*PREFIXES_COLUMNS).join(labels.join(sizes, "label"), "v", "left").withColumns({"label": F.coalesce("label", "v"), "size": F.coalesce("size", F.lit(1))})
    several = marked.groupBy("token").agg(F.max("held").alias("held"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token", "held", F.struct("x").alias("o"))
    return written(_met(marked, several).select(*PREFIXES_COLUMNS, "label", "size"), "mixed")


PREFIXES_COLUMNS = [x.split()[0] for x in PREFIXES.split(", ")]


def many_pairs(mixed: DataFrame) -> bool:
    """Whether the sets of small components meet in more than PAIRS_EACH pairs a row."""
    met = mixed.where(f"size < {LARGE}").groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows, pairs = met.agg(F.coalesce(F.sum("c"), F.lit(0.0)), F.coalesce(F.sum(F.expr("c * (c - 1) / 2")), F.lit(0.0))).first()
    return pairs > PAIRS_EACH * rows


def pairs_across(mixed: DataFrame) -> DataFrame:
    """(a, b): sets of different components, neither of them large, that a token can be the first to be shared by."""
    small = mixed.where(f"size < {LARGE}").withColumns({"salts": F.expr(f"cast(held div {HOT} as int)"), "salt": F.expr(f"cast(pmod(xxhash64(v), held div {HOT} + 1) as int)")})
    left = small.select("token", F.col("salt").alias("i"), F.explode(F.expr("sequence(salt, salts)")).alias("j"), "v", "n", "lone", "at", "label")
    right = small.select("token", F.explode(F.expr("sequence(0, salt)")).alias("i"), F.col("salt").alias("j"), F.struct("v", "n", "lone", "at", "label").alias("o"))
    meet = left.join(right, ["token", "i", "j"]).where(f"label <> o.label and (i < j or v < o.v) and {_needed('n', 'o.n')} <= least(n - lone, o.n - o.lone, n - at, o.n - o.at)")
    return meet.select(F.least("v", "o.v").alias("a"), F.greatest("v", "o.v").alias("b")).distinct()


def guests_across(mixed: DataFrame) -> DataFrame:
    """(a, label): sets and large components, larger than their own, with a member that a token can be the first to be shared with."""
    large = mixed.where(f"size >= {LARGE}").groupBy("token", "label", "size").agg(F.max("held").alias("held"), F.min("n").alias("n"), F.max(F.expr("n - lone")).alias("rest"), F.max(F.expr("n - at")).alias("tail"))
    large = large.select("token", "held", F.struct("label", "size", "n", "rest", "tail").alias("o"))
    meet = _met(mixed, large).where(f"label <> o.label and (size < o.size or size = o.size and label < o.label) and {_needed('n', 'o.n')} <= least(n - lone, o.rest, n - at, o.tail)")
    return meet.select(F.col("v").alias("a"), F.col("o.label").alias("label")).distinct()


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links among pairs (a, b) and around them, whole sets compared."""
    pairs = written(pairs.select("a", "b"), "pairs")
    if not (count := pairs.count()):
        return pairs
    pairs, hint = sized(pairs, count), F.broadcast if count <= TASK_ROWS else (lambda x: x)
    salts = pairs.groupBy("b").agg(F.expr(f"cast(count(*) div {SALT_ROWS} + 1 as int)").alias("salts"))
    dealt = pairs.join(salts, "b").select("a", "b", F.expr("cast(pmod(xxhash64(a), salts) as int)").alias("salt"))
    members = sets.select(F.col("v").alias("a"), "shingles").join(hint(dealt), "a").select("b", "salt", F.lit(1).alias("member"), "a", "shingles")
    heads = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    leads = sets.select(F.col("v").alias("b"), "shingles").join(hint(heads), "b").select("b", "salt", F.lit(0).alias("member"), F.col("b").alias("a"), "shingles")
    rows = leads.unionAll(members).repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return written(rows.mapInArrow(tidied(_compared), "a long, b long"), "links")


def _blocked(batches):
    """Rows sorted by (label, block, guest): a block of a component's sets, then guests; yields one link for each guest that has one."""
    key, ids, sets = None, [], []
    for batch in batches:
        got = []
        for label, block, guest, a, x in zip(*(batch.column(c).to_pylist() for c in ("label", "block", "guest", "a", "shingles")), strict=True):
            if (label, block) != key:
                key, ids, sets = (label, block), [], []
            x = np.frombuffer(x, np.uint64)
            if not guest:
                ids.append(a)
                sets.append(x)
                continue
            for i in range(0, len(sets), SALT_ROWS):
                hit = np.flatnonzero(trie_overlaps(x, sets[i : i + SALT_ROWS]) >= 0)
                if len(hit):
                    got.append((a, ids[i + hit[0]]))
                    break
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])


def _verified_in_blocks(sets: DataFrame, guests: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between guests (a, label) and the sets of that component, each compared with all of them."""
    counts = labels.join(guests.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.expr(f"cast(count(*) div {SALT_ROWS} + 1 as int)").alias("blocks"))
    own = labels.join(counts, "label").select("label", F.expr("cast(pmod(xxhash64(v), blocks) as int)").alias("block"), F.lit(0).alias("guest"), F.col("v").alias("a"))
    others = guests.join(counts, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("guest"), "a")
    rows = own.unionAll(others).join(sets.select(F.col("v").alias("a"), "shingles"), "a").repartition("label", "block").sortWithinPartitions("label", "block", "guest")
    return written(rows.mapInArrow(tidied(_blocked), "a long, b long"), "links")


def linked_sets(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate sets, and (v, label) of those that have a link."""
    sets = candidate_sets(docs, written(candidates(docs, ids), "candidates"))
    rows = prefixes_of(sets)
    links = _verified(sets, led(rows))
    labels, stale = components(links), True
    for turn in range(1, TURNS + 1):
        rows, stale = mixed_tokens(rows, labels), False
        if not many_pairs(rows):
            break
        more = _verified(sets, led_across(rows, turn))
        if more.isEmpty():
            break
        links, stale = links.unionAll(more), True
        labels = components(links)
    if stale:
        rows = mixed_tokens(rows, labels)
    more = _verified(sets, pairs_across(rows))
    guests = written(guests_across(rows), "guests")
    if not guests.isEmpty():
        more = more.unionAll(_verified_in_blocks(sets, guests, labels))
    return sets, labels if more.isEmpty() else components(links.unionAll(more))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set and the least id reachable by links."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    ids = written(docs.mapInArrow(tidied(_ids), f"id {kind}, {IDS}"), "ids")
    sets, labels = linked_sets(docs, ids)
    least = ids.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = sets.select("sid", "v").join(labels, "v").select("sid", "label")
    classes = written(least.join(named, "sid", "left"), "classes")
    tops = classes.where("label is not null").groupBy("label").agg(F.min("least").alias("top"))
    found = written(classes.join(tops, "label", "left").select("sid", "copies", F.expr("if(label is null, least, top)").alias("component_id")), "found")
    rows = ids.select("id", "n", "sid")
    some = joined_by_size(rows.where("n > 0"), found, "sid", "copies", ids.count())
    out = some.select("id", "n", "component_id").unionAll(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of the least id of each class; rows without shingles stay, and rows that share an id share a fate: they stay if one of them does."""
    name = fresh(docs, "dropped")
    rows = ngram_join(docs, id_col, text_col).select(F.col(id_col).alias(name), F.expr(f"n_shingles = 0 or component_id <=> `{id_col}`").alias("stays"))
    gone = written(rows.groupBy(name).agg(F.bool_or("stays").alias("stays")).where("not stays").select(name), "gone")
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
