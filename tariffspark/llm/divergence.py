"""Divergence of sources from each other and from their language, over an index built in a single pass.

1. Every task reads its documents once and keeps postings (language, source,
   term) -> (occurrences, documents) in memory. When ``block_postings`` are
   held, the block is spilled as one run: its postings are dealt to hash shards
   of (language, term), sorted by term, and leave the task as short pages.
2. Spark moves the pages to their shards in order of their first term. A shard
   heap-merges its runs: a page is opened when the merge reaches its first
   term and dropped at its last, so memory holds open pages only. Terms found in
   ``least_docs`` documents of the language come out with their frequencies.
3. Probabilities are whole numbers, ``1 + floor(1e9 (count + 1) / (N + V))``.
   A pair of sources differs over all V terms, but mostly by constants: what
   terms found in neither, or in one, add follows from N, V and a histogram
   of counts. Only for terms of both a correction is streamed, term by term.

Defined results: null text, language and source count as ''; texts without
terms belong to their group all the same; a language without kept terms has
V = 0, pairs of value 0 and no terms; repeated rows are documents of their own;
ties go to the smaller item in UTF-8 order; very long texts go through whole; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffspark.llm.lookups import bounded
from tariffspark.llm.text import whole
from tariffspark.session import materialize

SCALE = 1_000_000_000
PAGE = "shard int, lang string, first binary, run long, terms binary, sources array<string>, places binary, counts binary, docs binary"


def _runs(shards: int, block_postings: int, page_postings: int):
    """(lang, source, text) -> pages of term-sorted runs; a page without terms names the groups of a block."""

    def run(batches):
        import zlib
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        upper = range(ord("A"), ord("Z") + 1)
        table = bytes(c + 32 if c in upper else c if c >= 0x80 or ord("a") <= c <= ord("z") else 0x20 for c in range(256))
        kinds = [pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in PAGE.split(", ")]
        part, block, held, spilled = TaskContext.get().partitionId(), {}, 0, 0

        def pages():
            nonlocal block, held, spilled
            number = (part << 32) + spilled
            by_lang = {}
            for (lang, source), (counts, docs) in block.items():
                by_lang.setdefault(lang, []).append((source, counts, docs))
            for lang, groups in by_lang.items():
                salt = zlib.crc32(lang.encode())
                sources = sorted(s for s, _, _ in groups)
                place = {s: i for i, s in enumerate(sources)}
                dealt = {}
                for source, counts, docs in groups:
                    at = place[source]
                    for term, n in counts.items():
                        dealt.setdefault(zlib.crc32(term, salt) % shards, []).append((term, at, n, docs[term]))
                yield (salt % shards, lang, b"", number, b"", sources, b"", b"", b"")
                for shard, postings in dealt.items():
                    postings.sort()
                    for i in range(0, len(postings), page_postings):
                        terms, at, n, docs = zip(*postings[i:i + page_postings])
                        used = sorted(set(at))
                        local = np.searchsorted(used, at).astype("<i4")
                        yield (shard, lang, terms[0], number, b" ".join(terms), [sources[u] for u in used], local.tobytes(),
                               np.array(n, dtype="<i8").tobytes(), np.array(docs, dtype="<i8").tobytes())
            block, held, spilled = {}, 0, spilled + 1

        def out(rows, size=4096):
            rows = list(rows)
            for i in range(0, len(rows), size):
                yield pa.record_batch([pa.array([r[j] for r in rows[i:i + size]], kinds[j]) for j in range(len(kinds))], names=names)

        for batch in batches:
            for lang, source, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (lang, source) not in block:
                    block[lang, source] = (Counter(), Counter())
                counts, docs = block[lang, source]
                held -= len(counts)
                words = text.encode().translate(table).split()
                counts.update(words)
                docs.update(set(words))
                held += len(counts)
                if held >= block_postings:
                    yield from out(pages())
        if block:
            yield from out(pages())

    return run


def _merged(least_docs: int):
    """Pages in order of (shard, lang, first) -> (lang, term, source, count, held, lead): frequencies of the kept terms.

    ``held``: occurrences in the whole language, ``lead`` marks one row per term. Rows without a term name the groups.
    """

    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        names = ["lang", "term", "source", "count", "held", "lead"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        heap, opened, now, found, rows = [], 0, None, {}, []

        def opened_page(terms, sources, places, counts, docs):
            terms = terms.split(b" ") if terms else [b""] * len(sources)
            if not places:
                return list(zip(terms, sources, [0] * len(terms), [0] * len(terms)))
            return list(zip(terms, [sources[i] for i in np.frombuffer(places, "<i4")], np.frombuffer(counts, "<i8").tolist(), np.frombuffer(docs, "<i8").tolist()))

        def close():
            if now is None:
                return
            lang, term = now[1:]
            if not term:
                rows.extend((lang, None, s, 0, 0, False) for s in sorted(found))
            elif sum(d for _, d in found.values()) >= least_docs:
                total = sum(n for n, _ in found.values())
                rows.extend((lang, term.decode(), s, *(found[s][0], total, i == 0)) for i, s in enumerate(sorted(found)))

        def take():
            nonlocal now, found
            key, number, page, at = heap[0]
            if key != now:
                close()
                now, found = key, {}
            term = key[2]
            while at < len(page) and page[at][0] == term:
                _, source, n, d = page[at]
                old = found.get(source, (0, 0))
                found[source] = (old[0] + n, old[1] + d)
                at += 1
            if at < len(page):
                heapq.heapreplace(heap, ((key[0], key[1], page[at][0]), number, page, at))
            else:
                heapq.heappop(heap)

        def batch_of():
            nonlocal rows
            out, rows = rows, []
            return pa.record_batch([pa.array([r[i] for r in out], kinds[i]) for i in range(len(kinds))], names=names)

        for batch in batches:
            for shard, lang, first, _, *page in zip(*[c.to_pylist() for c in batch.columns]):
                key = (shard, lang, first)
                while heap and heap[0][0] < key:
                    take()
                if len(rows) >= 10_000:
                    yield batch_of()
                heapq.heappush(heap, (key, opened, opened_page(*page), 0))
                opened += 1
        while heap:
            take()
            if len(rows) >= 10_000:
                yield batch_of()
        close()
        if rows:
            yield batch_of()

    return run


def frequencies(docs: DataFrame, least_docs: int = 3, block_postings: int = 1 << 18, page_postings: int = 1024, text_column: str = "text",
                lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, term, source, count, held, lead) of the kept terms, and a row without a term for every (lang, source), written."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(whole(F.col(lang_column)).alias("lang"), whole(F.col(source_column)).alias("source"), whole(F.col(text_column)).alias("text"))
    pages = texts.mapInArrow(_runs(shards, block_postings, page_postings), PAGE)
    merged = (pages.repartition("shard").sortWithinPartitions("shard", "lang", "first", "run")
              .mapInArrow(_merged(least_docs), "lang string, term string, source string, count long, held long, lead boolean"))
    return materialize(merged, "divergence-terms")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 (count + 1) / (total + terms)), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)")) + 1


def chi(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections():
    """Rows (lang, term, source, p, p0) in order of (lang, term) -> (lang, source, other, high, low): what terms of both add, as high * 2^32 + low."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["lang", "source", "other", "high", "low"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        groups, known, sums, held = {}, [], {}, None
        number, last = 0, None

        def f(p, q):
            return (p - q) * (p - q) // q

        def add(group, term, p, p0):
            keys, values = [], []
            for step in range(1, len(group)):
                same = np.flatnonzero(term[step:] == term[:-step])
                if not len(same):
                    break
                for a, b in ((same, same + step), (same + step, same)):
                    keys.append((group[a].astype(np.int64) << 32) + group[b])
                    values.append(f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            if not keys:
                return
            keys, values = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            high, low = np.add.reduceat(values >> 32, starts), np.add.reduceat(values & 0xFFFFFFFF, starts)
            for k, h, lo in zip(keys[starts].tolist(), high.tolist(), low.tolist()):
                old = sums.get(k, (0, 0))
                sums[k] = (old[0] + h, old[1] + lo)

        def out():
            rows = [(*known[k >> 32], known[k & 0xFFFFFFFF][1], h, lo) for k, (h, lo) in sums.items()]
            sums.clear()
            return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, source = batch.column(0), batch.column(1), batch.column(2)
            langs, sources = lang.dictionary_encode(), source.dictionary_encode()
            pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            pairs, place = np.unique(pair, return_inverse=True)
            for key in (keys := [(langs.dictionary[int(p) // len(sources.dictionary)].as_py(), sources.dictionary[int(p) % len(sources.dictionary)].as_py()) for p in pairs]):
                if key not in groups:
                    groups[key] = len(known)
                    known.append(key)
            group = np.array([groups[k] for k in keys], dtype=np.int64)[place]
            # Terms are numbered as they come; the first of a batch may be the last of the one before.
            again = last is not None and last == (lang[0].as_py(), term[0].as_py())
            fresh = [np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))) for c in (lang, term)]
            number += not again
            code = number + np.append(0, np.cumsum(fresh[0] | fresh[1]))
            number, last = int(code[-1]), (lang[-1].as_py(), term[-1].as_py())
            columns = [group, code, batch.column(3).to_numpy(), batch.column(4).to_numpy()]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            # Whole terms only; the last one may go on in the next batch.
            tail = int(np.searchsorted(columns[1], number))
            held = [c[tail:] for c in columns]
            add(*[c[:tail] for c in columns])
            if len(sums) > 500_000:
                yield out()
        if held is not None:
            add(*held)
        if sums:
            yield out()

    return run


def audit(docs: DataFrame, top_terms: int = 200, **settings) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against every other source of the language, part ``term`` the terms a source has above its language."""
    table = frequencies(docs, **settings)
    terms = table.where("term is not null")
    langs = table.groupBy("lang").agg(F.count(F.when(F.col("lead"), 1)).alias("v"), F.coalesce(F.sum(F.when(F.col("lead"), F.col("held"))), F.lit(0)).alias("lang_n"))
    groups = materialize(table.groupBy("lang", "source").agg(F.sum("count").alias("n")).join(bounded(materialize(langs, "divergence-langs")), "lang"), "divergence-groups")
    # V = 0: the language has no terms, nothing below divides by it.
    size = F.col("n") + F.col("v")
    groups = groups.withColumn("p0", F.when(size > 0, probability(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)))

    p, q = probability(F.col("count"), F.col("n"), F.col("v")), probability(F.col("held"), F.col("lang_n"), F.col("v"))
    known = terms.join(bounded(groups), ["lang", "source"]).withColumn("p", p)
    above = known.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), chi(F.col("p"), F.col("q")).alias("value"))

    ends = groups.select("lang", "source", "v", "p0")
    pairs = (ends.join(bounded(ends.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))), "lang")
             .where("source <> other").withColumn("base", chi(F.col("p0"), F.col("q0"))))
    big = "decimal(38,0)"
    counts = materialize(known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")), "divergence-counts")
    # Terms of the one side: the other has its constant.
    mine = (counts.join(bounded(pairs), ["lang", "source"])
            .select("lang", "source", "other", (F.col("times").cast(big) * (chi(F.col("p"), F.col("q0")) - F.col("base"))).alias("add")))
    theirs = (counts.withColumnRenamed("source", "other").join(bounded(pairs), ["lang", "other"])
              .select("lang", "source", "other", (F.col("times").cast(big) * (chi(F.col("p0"), F.col("p")) - F.col("base"))).alias("add")))
    both = (known.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_corrections(), "lang string, source string, other string, high long, low long")
            .select("lang", "source", "other", (F.col("high").cast(big) * F.lit(1 << 32) + F.col("low")).cast(big).alias("add")))
    base = pairs.select("lang", "source", "other", (F.col("v").cast(big) * F.col("base")).cast(big).alias("add"))
    total = (mine.select("lang", "source", "other", F.col("add").cast(big)).unionByName(theirs.select("lang", "source", "other", F.col("add").cast(big)))
             .unionByName(both).unionByName(base).groupBy("lang", "source", "other").agg(F.sum("add").cast("long").alias("value")))
    between = total.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (above.withColumn("rank", ranked).where(F.col("rank") <= top_terms)
            .unionByName(between.withColumn("rank", ranked)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))
