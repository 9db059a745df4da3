"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles, kept as 64-bit hashes
(a set of hashes stands for the set of shingles). Equal sets form one class.

1. Tokens are put in one global order: by document frequency, capped, then by
   hash. If two sets reach the threshold t, of the first
   ``n - ceil(t n) + 1`` tokens of either at least one is in the other, and of
   the set whose prefix ends first all these lie in both prefixes.
2. Frequencies are counted on a fixed part of the hash range for large sets
   (any part works, the order only has to be global) and on all tokens for
   small ones; both kinds overlap, so that every possible pair meets in one.
   Tokens of a single set never make a pair and are only counted.
3. Rare tokens are indexed singly. Where a prefix runs into frequent tokens it
   is extended, these tokens are cut into ``m`` classes by hash, and pairs of
   tokens of one class are indexed: a prefix with ``c_j`` tokens of class j may
   lose ``sum(c_j - 1)`` tokens before no class has two left.
4. Sets that share a key are verified exactly, but not all with all. First
   each meets one pivot of the key, the set with the fewest tokens of its own,
   which is the middle of a group of near copies. What is linked becomes a
   component, and from there on only sets of different components are compared:
   those near a common pivot in blocks, which give back no more links than
   join their components. Jaccard distances obey the triangle inequality, so
   all that is linked to a set well inside such a block is in the block too,
   and the set leaves the key. Where the rows left could make more pairs than
   the index has rows, each key takes another pivot, for as long as that
   settles a good part of them: a round makes one row per row, never a pair.
   The rest meet pair by pair, within the bounds on length and position and
   unless their distances to a common pivot differ by more than linked sets
   may. No link between components is lost. Keys with the same sets behind
   them, as copies make them, count as one from the start.

Defined results: null texts and texts without words have no shingles, link
with nothing and are their own component; equal sets are linked; component_id
is the least doc_id, null only where no member has an id; equal rows get equal
results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffspark.llm.components import connected_components
from tariffspark.llm.lookups import bounded
from tariffspark.llm.text import free_names, text_key
from tariffspark.session import materialize

PART = 0.3          # share of the hash range that is counted for large sets
SMALL = 240         # sets up to this size use all their tokens
RARE = 64           # document frequency up to which a token is indexed singly
SPREAD = 256        # partners that one copy of a set serves in verification
NEAR = 30           # percent of similarity to a pivot that puts a set into its cell
BLOCK = 256         # sets on either side of a block
OPEN = 1            # pairs per index row that pivots may leave to be compared one by one


def shingler(n: int):
    """(texts) -> list of sorted arrays of shingle hashes; for use inside tasks."""

    def shingles(texts):
        import numpy as np
        import pandas as pd

        lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
        words = [(t or "").encode().translate(lower).split() for t in texts]
        flat = np.empty(sum(map(len, words)), dtype=object)
        at = 0
        for w in words:
            flat[at:at + len(w)] = w
            at += len(w)
        h = pd.util.hash_array(flat, categorize=True) if at else np.empty(0, dtype=np.uint64)

        def mixed(x):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64)) for i in range(n)]
        out, at = [], 0
        for w in words:
            own, at = h[at:at + len(w)], at + len(w)
            size = min(n, len(own))
            if not size:
                out.append(np.empty(0, dtype=np.uint64))
                continue
            total = np.full(len(own) - size + 1, np.uint64(size), dtype=np.uint64)
            for i in range(size):
                total += mixed(own[i:len(own) - size + 1 + i] * odd[i])
            out.append(np.unique(mixed(total)))
        return out

    return shingles


def sizes(percent: int):
    """For use inside tasks: length of the prefix by a set's size, size class by size, classes of frequent
    tokens by size class, and how many tokens always end an extended prefix."""
    import math

    def need(n):
        return n + (-percent * n // 100) + 1

    def size_class(n):
        return int(math.log(n) / -math.log(percent / 100) + 1e-9)

    def token_classes(c):
        return int((percent / 100) ** -c * (1 - percent / 100) / 4)

    def enough(n):
        return need(n) + token_classes(size_class(n) + 1) + 1

    return need, size_class, token_classes, enough


def _sets(n: int, percent: int):
    """Rows (doc_id, main, rid, n, key, low, tokens): one per document, and one more where a set belongs to both sides.

    ``low``: how many of the set's tokens lie in the counted part of their side.
    A large set that has too few of them gives all its tokens.
    """
    shingles, enough = shingler(n), sizes(percent)[3]
    part, small = int(PART * (1 << 64)), SMALL
    least_large = -(-small * percent // 100)

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        seen = set()
        kinds = pa.schema([("doc_id", pa.int64()), ("main", pa.bool_()), ("rid", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("low", pa.int32()), ("tokens", pa.list_(pa.int64()))])
        for batch in batches:
            rows = []
            for doc, key, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingles(batch.column(1).to_pylist())):
                size = len(own)
                rid = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if size else None
                if not size or rid in seen:
                    rows.append((doc, True, rid, size, key, 0, None))
                    continue
                seen.add(rid)
                main = True
                if size <= small:
                    # The lowest bit names the side, so that both sides share one index.
                    rows.append((doc, True, rid, size, key, size, (own | np.uint64(1)).view(np.int64)))
                    main = False
                if size >= least_large:
                    low = own[:np.searchsorted(own, np.uint64(part))]
                    used = low if len(low) >= enough(size) else own
                    rows.append((doc if main else None, main, rid, size, key, len(low), (used & ~np.uint64(1)).view(np.int64)))
            columns = [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(7)]
            yield pa.record_batch(columns, schema=kinds)

    return run


def _shared(rare: int):
    """Rows (token, rid, n, low) sorted by token and set -> the same with the capped frequency, for tokens of two sets or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["token", "rid", "n", "low", "df"]
        hot, last = None, None  # a token known to be frequent, and its latest set

        def out(t, r, n, a, df):
            return pa.record_batch([pa.array(t), pa.array(r), pa.array(n), pa.array(a), pa.array(df.astype(np.int32))], names=names)

        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            held = None
            if not len(cols[0]):
                continue
            t, r = cols[0], cols[1]
            fresh = np.ones(len(t), dtype=bool)
            fresh[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
            if hot is not None and t[0] == hot and r[0] == last:
                fresh[0] = False
            last_row = (t[-1], r[-1])
            t, r, n, a = (x[fresh] for x in cols)
            if hot is not None:
                more = t == hot
                if more.any():
                    yield out(t[more], r[more], n[more], a[more], np.full(more.sum(), rare + 1))
                    t, r, n, a = t[~more], r[~more], n[~more], a[~more]
                if last_row[0] == hot:
                    last = last_row[1]
                    continue
                hot = None
            if not len(t):
                continue
            tail = np.searchsorted(t, t[-1])
            if len(t) - tail > rare:
                # The run at the end is frequent whatever follows: pass it on now, so that no token's sets are gathered.
                hot, last = t[-1], r[-1]
                tail = len(t)
            else:
                held = [x[tail:] for x in (t, r, n, a)]
            if tail:
                t, r, n, a = t[:tail], r[:tail], n[:tail], a[:tail]
                starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                df = np.repeat(np.diff(np.r_[starts, len(t)]), np.diff(np.r_[starts, len(t)]))
                keep = df > 1
                yield out(t[keep], r[keep], n[keep], a[keep], np.minimum(df[keep], rare + 1))
        if held is not None and len(held[0]) > 1:
            yield out(*held, np.full(len(held[0]), min(len(held[0]), rare + 1)))

    return run


def _prefixes(rare: int, percent: int):
    """Rows (rid, n, low, df, token) in the global order within set and side -> index rows (key, rid, n, pos).

    ``pos`` is at most the place of the first token that the set can have in
    common with a set that shares the key and no earlier key.
    """
    need_of, size_class, token_classes, enough = sizes(percent)
    part = int(PART * (1 << 64))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        np.seterr(over="ignore")
        gold = np.uint64(0x9E3779B97F4A7C15)
        kinds = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

        def walk(c, need, alone, blocks):
            """Keys of the prefix with the classes of size class ``c``, and whether frequent tokens were needed."""
            m, salt = token_classes(c), np.uint64((0xD6E8FEB86659FD93 * (2 * c + 1)) % (1 << 64))
            found, met, counted, place, open_at = [], {}, 0, 0, None
            for i, (tokens, df) in enumerate(blocks):
                counted, place = counted + alone[i], place + alone[i]
                for t, f in zip(tokens, df):
                    if counted >= need:
                        return found, open_at is not None
                    place += 1
                    if f <= rare:
                        found.append((t.view(np.int64), open_at or place))
                        counted += 1
                        continue
                    open_at = open_at or place
                    if m < 2:
                        found.append((((t ^ salt) * gold).view(np.int64), open_at))
                        counted += 1
                        continue
                    kin = met.setdefault(int((t >> np.uint64(8)) % np.uint64(m)), [])
                    found += [((((x * gold) ^ (t * np.uint64(0xC2B2AE3D27D4EB4F)) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), open_at) for x in kin]
                    counted += bool(kin)
                    kin.append(t)
            return found, open_at is not None

        def flush(rid, n, low, df, token):
            n, low, token = int(n[0]), int(low[0]), token.view(np.uint64)
            late = ((token & np.uint64(1)) == 0) & (token >= np.uint64(part))
            early = int((~late).sum())
            every = low < n and low < enough(n)
            # Tokens of this set only come first in their part and need no key; without the late part nothing follows.
            alone = [low - early, n - low - int(late.sum()) if every else 0]
            if alone[0] >= need_of(n):
                return []
            blocks = [(token[:early], df[:early]), (token[early:], df[early:])]
            keys, frequent = walk(size_class(n), need_of(n), alone, blocks)
            if frequent:
                keys = {*keys, *walk(size_class(n) + 1, need_of(n), alone, blocks)[0]}
            return [(int(k), int(rid[0]), n, int(p)) for k, p in keys]

        held = None
        for batch in batches:
            cols = [batch.column(batch.schema.names.index(x)).to_numpy(zero_copy_only=False) for x in ("rid", "n", "low", "df", "token")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            side = cols[4] & 1
            starts = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (side[1:] != side[:-1])) + 1).tolist()]
            held = [x[starts[-1]:] for x in cols]  # one set's tokens, as many as its text has words
            rows = [row for a, b in zip(starts, starts[1:]) for row in flush(*[x[a:b] for x in cols])]
            if rows:
                yield pa.record_batch([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(4)], schema=kinds)
        if held is not None and len(held[0]) and (rows := flush(*held)):
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(4)], schema=kinds)

    return run


def _full(n: int):
    """(text) rows -> (rid, tokens as bytes)."""
    shingles = shingler(n)

    def run(batches):
        import hashlib

        import pyarrow as pa

        kinds = pa.schema([("rid", pa.int64()), ("tokens", pa.binary())])
        for batch in batches:
            blobs = [x.tobytes() for x in shingles(batch.column(0).to_pylist())]
            rids = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in blobs]
            yield pa.record_batch([pa.array(rids, pa.int64()), pa.array(blobs, pa.binary())], schema=kinds)

    return run


def _overlaps():
    """Rows (a, salt, b, tokens) sorted so that the set of a (b null) comes before its partners -> (a, b, both)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int32())])
        own = None
        for batch in batches:
            out = []
            for a, b, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                tokens = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if b is None:
                    own = tokens.copy()
                else:
                    out.append((a, b, len(np.intersect1d(own, tokens, assume_unique=True))))
            if out:
                yield pa.record_batch([pa.array([r[i] for r in out], kinds.field(i).type) for i in range(3)], schema=kinds)

    return run


def _scored(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Distinct ``pairs(a, b, na, nb)`` with the size of the intersection. A set goes once to each ``SPREAD`` of its partners.

    The ids are written and counted first, so that few of them are broadcast to the token sets, which then move only where a pair needs them.
    """
    pairs = materialize(pairs, "jaccard-pairs")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts"))
    salted = materialize(pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "jaccard-salted")
    hubs = materialize(salted.select("a", "salt").distinct(), "jaccard-hubs")
    left = sets.withColumnRenamed("rid", "a").join(bounded(hubs), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens")
    right = sets.withColumnRenamed("rid", "b").join(bounded(salted), "b").select("a", "salt", "b", "tokens")
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(rows.mapInArrow(_overlaps(), "a long, b long, both int").join(pairs, ["a", "b"]), label)


def _at_least(percent: int):
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def _block_links(percent: int):
    """Rows (cell, kind, i, j, role, component, tokens) sorted by block and role -> links (u, v) that join components.

    Role 0 meets role 1, or itself where a block has no role 1. All pairs of a
    block are compared by one matrix product per slice of tokens.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def links(rows):
            roles = np.array([r[4] for r in rows])
            sets = [np.frombuffer(r[7], dtype=np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])
            left = np.flatnonzero(roles == 0)
            right = np.flatnonzero(roles == 1) if (roles == 1).any() else left
            value, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), size)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            both = np.zeros((len(left), len(right)), dtype=np.float32)
            for start in range(0, len(value), 4096):
                a, b = np.searchsorted(code, [start, start + 4096])
                part = np.zeros((len(rows), 4096), dtype=np.float32)
                part[owner[a:b], code[a:b] - start] = 1
                both += part[left] @ part[right].T
            both = both.astype(np.int64)
            linked = both * 100 >= (size[left][:, None] + size[right][None, :] - both) * percent
            root = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            out = []
            for x, y in zip(*np.nonzero(linked)):
                x, y = rows[left[x]], rows[right[y]]
                cx, cy = find(x[6]), find(y[6])
                if cx != cy:
                    root[cx] = cy
                    out.append((x[5], y[5]))
            return out

        held = []
        for batch in batches:
            rows, out = held + list(zip(*[c.to_pylist() for c in batch.columns])), []
            start = 0
            for k in range(1, len(rows)):
                if rows[k][:4] != rows[k - 1][:4]:
                    out += links(rows[start:k])
                    start = k
            held = rows[start:]
            if out:
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], schema=kinds)
        if held and (out := links(held)):
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], schema=kinds)

    return run


def _cell_links(near: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside every cell: a pivot and the sets near it, ``near(a, b)``.

    Members of the pivot's own component need not meet each other; the others
    (satellites) meet all, in blocks of about ``BLOCK`` by ``BLOCK`` sets.
    """
    members = near.unionByName(near.select("a", F.col("a").alias("b")).distinct())
    component = groups.withColumnRenamed("node", "b")
    placed = members.join(component, "b", "left").withColumn("component", F.coalesce("component", "b"))
    home = placed.where("a = b").select("a", F.col("component").alias("home"))
    placed = materialize(placed.join(home, "a").withColumn("satellite", F.col("component") != F.col("home")), "jaccard-cells")
    count = placed.groupBy("a").agg(F.ceil(F.count(F.when(F.col("satellite"), 1)) / BLOCK).cast("int").alias("ns"),
                                    F.ceil(F.count(F.when(~F.col("satellite"), 1)) / BLOCK).cast("int").alias("nc")).where("ns > 0")
    cut = placed.join(count, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.when(F.col("satellite"), F.col("ns")).otherwise(F.col("nc"))).cast("int"))
    to = F.expr("""if(satellite,
      concat(transform(sequence(0, ns - 1), o -> named_struct('kind', 0, 'i', least(own, o), 'j', greatest(own, o), 'role', int(own > o))),
             transform(sequence(0, nc - 1), o -> named_struct('kind', 1, 'i', own, 'j', o, 'role', 0))),
      transform(sequence(0, ns - 1), o -> named_struct('kind', 1, 'i', o, 'j', own, 'role', 1)))""")
    cut = bounded(materialize(cut, "jaccard-cut"))
    rows = (sets.withColumnRenamed("rid", "b").join(cut, "b").select("a", "b", "component", "tokens", F.explode(to).alias("t"))
            .select("a", "t.kind", "t.i", "t.j", "t.role", "b", "component", "tokens"))
    return rows.repartition("a", "kind", "i", "j").sortWithinPartitions("a", "kind", "i", "j", "role").mapInArrow(_block_links(percent), "u long, v long")


def _possible(a: str, b: str, percent: int):
    """Bounds on length and position for two index rows of one key."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) + 1
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (most * (100 + percent) >= (na + nb) * percent)


def classes(docs: DataFrame, shingle: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key of the text, n_shingles, and of its component the least id with its text key."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), text_key(F.col(text_column)).alias("key"))
    made = materialize(source.mapInArrow(_sets(shingle, percent), "doc_id long, main boolean, rid long, n int, key binary, low int, tokens array<long>"), "jaccard-sets")
    exploded = made.where("tokens is not null").select(F.explode("tokens").alias("token"), "rid", "n", "low")
    shared = (exploded.repartition("token").sortWithinPartitions("token", "rid")
              .mapInArrow(_shared(RARE), "token long, rid long, n int, low int, df int"))
    late = F.expr(f"token & 1 = 0 and not token between 0 and {int(PART * (1 << 64)) - 1}")
    index = (shared.withColumn("side", F.expr("token & 1")).withColumn("late", late).repartition("rid")
             .sortWithinPartitions("rid", "side", "late", "df", "token").mapInArrow(_prefixes(RARE, percent), "key long, rid long, n int, pos int"))
    index = materialize(index, "jaccard-index")
    # Copies share many keys, and mostly the same sets stand behind each: such keys become one, named by its members and with
    # each set's least position. Should two names ever meet, sets are compared that need not be, no more.
    members = [F.min("rid"), F.max("rid"), F.count(F.lit(1)), F.bit_xor(F.xxhash64("rid")), F.bit_xor(F.xxhash64("rid", F.lit(1)))]
    named_keys = (index.groupBy("key").agg(*[m.alias(f"m{i}") for i, m in enumerate(members)]).where("m0 <> m1")
                  .select("key", F.xxhash64(*[f"m{i}" for i in range(len(members))]).alias("group")))
    index = materialize(index.join(named_keys, "key").groupBy(F.col("group").alias("key"), "rid", "n").agg(F.min("pos").alias("pos")), "jaccard-index")
    wanted = index.select("rid").distinct()
    keys = made.where("main and rid is not null").groupBy("rid").agg(F.min("key").alias("key")).join(wanted, "rid")
    keys = materialize(keys.select("key"), "jaccard-keys")
    texts = source.join(bounded(keys), "key", "left_semi").select("key", "text").dropDuplicates(["key"]).select("text")
    sets = materialize(texts.mapInArrow(_full(shingle), "rid long, tokens binary"), "jaccard-tokens")

    links, settled = None, None
    rows = index.withColumn("far", F.lit(True)).withColumn("marks", F.array().cast("array<struct<pivot: long, far: double, near: boolean>>"))
    most, before, most_away = OPEN * index.count(), None, (100 - percent) / 100
    while True:
        # The pivot is near no other if it can be. All sets of the key meet it, also those that can't be linked to it: what counts is how far they are.
        first = rows.groupBy("key").agg(F.min(F.struct((~F.col("far")).alias("near"), "pos", "rid", "n")).alias("first"))
        rows = materialize(rows.join(first.select("key", F.col("first.rid").alias("pivot"), F.col("first.n").alias("pivot_n")), "key"), "jaccard-round")
        rest = rows.where("rid <> pivot")
        scored = _scored(rest.select(F.col("pivot").alias("a"), F.col("rid").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb")).distinct(), sets, "jaccard-stars")
        found = scored.where(_at_least(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = found if links is None else links.unionByName(found)
        groups = materialize(connected_components(links, "jaccard-groups"), "jaccard-groups")
        # A cell may hold any sets, as all of its pairs are settled; a wide one takes in near copies of near copies.
        near = scored.where(_at_least(NEAR)).select("a", "b")
        inside = materialize(_cell_links(near, groups, sets, percent), "jaccard-links")
        settled = inside if settled is None else settled.unionByName(inside)

        met = scored.select(F.col("a").alias("pivot"), F.col("b").alias("rid"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("away"),
                            _at_least(NEAR).alias("near"))
        # Whatever is linked to a set this close to the pivot lies in the cell, too: the key has nothing left for the set.
        edge = (100 - NEAR) / 100 - most_away - 1e-9
        rows = (rest.join(met, ["pivot", "rid"]).where(F.col("away") > edge)
                .select("key", "rid", "n", "pos", "near", (F.col("far") & ~F.col("near")).alias("far"),
                        F.concat("marks", F.array(F.struct("pivot", F.col("away").alias("far"), "near"))).alias("marks"))
                .join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")))
        rows = materialize(rows, "jaccard-open")
        # Pairs that lie in the cell of this round's pivot are settled; sets near different pivots have yet to meet.
        c, inner = F.count(F.lit(1)), F.count(F.when(F.col("near"), 1))
        divided = (rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), ((c * (c - 1) - inner * (inner - 1)) / 2).alias("pairs"))
                   .where("lo <> hi and pairs > 0").select("key", "pairs"))
        divided = materialize(divided, "jaccard-divided")
        rows = materialize(rows.join(divided.select("key"), "key", "left_semi").drop("near"), "jaccard-open")
        # Another round pays where many pairs are left for the sets, and as long as rounds take a good part of them away.
        pairs = divided.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if pairs <= most or (before is not None and pairs > 0.8 * before):
            break
        before, rows = pairs, rows.drop("component")

    # What is left: pairs across components that share no cell, and whose distances to a common pivot allow them.
    apart = F.expr(f"exists(x.marks, m -> exists(y.marks, o -> o.pivot = m.pivot and (m.near and o.near or abs(o.far - m.far) > {most_away + 1e-9})))")
    unlike = ((F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")) & (F.col("x.component") != F.col("y.component"))
              & _possible("x", "y", percent) & ~apart)
    across = rows.alias("x").join(rows.alias("y"), unlike).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    outside = _scored(across.distinct(), sets, "jaccard-across").where(_at_least(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    groups = connected_components(links.unionByName(settled).unionByName(outside), "jaccard-groups")

    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    named = (made.where("main and rid is not null").groupBy("rid").agg(F.min(first).alias("first"))
             .join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")))
    named = materialize(named, "jaccard-names")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    table = materialize(named.join(heads, "component").select(F.col("rid").alias("__rid"), "head"), "jaccard-classes")
    rows = made.where("main").select("doc_id", "key", "rid", F.col("n").cast("long").alias("n_shingles"))
    met = rows.join(bounded(table), F.col("rid") == F.col("__rid"), "left")
    alone = F.col("rid").isNull()
    return met.select("doc_id", "key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
                      F.when(alone, F.col("key")).otherwise(F.col("head.key")).alias("head_key"))


def jaccard_components(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return classes(docs, **settings).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of every component, that of the least id; documents without words all stay."""
    found = classes(docs, id_column=id_column, text_column=text_column, **settings)
    head = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("key").eqNullSafe(F.col("head_key"))
    # Rows of one id and one text are told apart by nothing that matters here; where there are several, one is kept.
    verdict = found.groupBy("doc_id", "key").agg(F.max(head).alias("head"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    odd = materialize(verdict.where("not head or (rows > 1 and n > 0)").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "head"), "jaccard-gone")
    mark, own, of, text = free_names(docs.columns, "__mark", "__text", "__id", "__key")
    keyed = docs.withColumn(own, text_key(F.col(text_column)))
    met = keyed.join(bounded(odd.select(F.col("__id").alias(of), F.col("__key").alias(text), F.col("head").alias(mark))),
                     F.col(id_column).cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(text)), "left").drop(of, text)
    columns = [f"`{c}`" for c in docs.columns]
    several = met.where(F.col(mark)).dropDuplicates([id_column, own])
    return met.where(F.col(mark).isNull()).select(*columns).unionByName(several.select(*columns))
