"""Fill-in-the-middle transformation over piece tables.

A batch of texts is one immutable buffer, the sentinels are another. A document
is a short list of descriptors (buffer, start, end); cutting it splits one
descriptor in two, an arrangement permutes descriptors and puts sentinel
descriptors between them, the inverse permutation restores the text. Hashes are
fed descriptor by descriptor. No text is copied unless its output is asked for.

A text is cut into units ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+``, and one more
for trailing white space. Four numbers drawn from sha256 of ``seed:doc_id``
decide where it is cut and how it is arranged, so reruns agree on any cluster.

Defined results: null texts count as empty, and empty texts stay plain, as do
texts that hold a sentinel; a null id draws as the empty string; equal rows get
equal results; very long texts go through in one piece, as the batch that holds
them does; an empty table gives no rows; other columns pass through, and the
new column is renamed where its name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffspark.llm.text import free_names, whole

# Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# Order of the pieces (0 prefix, 1 middle, 2 suffix) and the sentinel of each place.
FORMS = {"psm": ((0, 2, 1), (PREFIX, SUFFIX, MIDDLE)), "spm": ((2, 0, 1), (SUFFIX, PREFIX, MIDDLE))}
FIELDS = "n: long, form: string, prefix_chars: long, middle_chars: long, output_sha256: string, restored_sha256: string"


class PieceTable:
    """Descriptors over buffers that nobody changes."""

    def __init__(self, buffers, pieces):
        self.buffers, self.pieces = buffers, pieces

    def views(self):
        return [self.buffers[b][start:end] for b, start, end in self.pieces]

    def cut(self, places):
        """A table whose descriptors also end at ``places``, offsets from the start of the document."""
        out, at, rest = [], 0, sorted(places)
        for buffer, start, end in self.pieces:
            while rest and rest[0] <= at + end - start:
                middle = start + rest.pop(0) - at
                out.append((buffer, start, middle))
                at, start = at + middle - start, middle
            out.append((buffer, start, end))
            at += end - start
        return PieceTable(self.buffers, out)

    def arranged(self, order):
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def digest(self):
        import hashlib

        h = hashlib.sha256()
        for view in self.views():
            h.update(view)
        return h.hexdigest()


def arrange(table: PieceTable, form: str, sentinels: dict) -> PieceTable:
    """prefix, middle, suffix -> sentinel and piece by turns, in the order of ``form``."""
    order, marks = FORMS[form]
    moved = table.arranged(order).pieces
    return PieceTable(table.buffers, [d for mark, piece in zip(marks, moved) for d in (sentinels[mark], piece)])


def restore(output, form: str) -> PieceTable:
    """The text's descriptors over an output: found between its sentinels, put back by the inverse permutation.

    No piece holds a sentinel and none can arise where two pieces meet, so the first find of each is the right one.
    """
    if form not in FORMS:
        return PieceTable([memoryview(output)], [(0, 0, len(output))])
    order, marks = FORMS[form]
    starts, at = [], 0
    for mark in marks:
        at = output.index(mark, at) + len(mark)
        starts.append(at)
    ends = [s - len(m) for s, m in zip(starts[1:], marks[1:])] + [len(output)]
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return PieceTable([memoryview(output)], [(0, s, e) for s, e in zip(starts, ends)]).arranged(inverse)


def _transform(seed: str, rate: int, spm_share: int, with_output: bool):
    """Batches whose last two columns are id and text -> the other columns and the struct of the result."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        marks = b"".join((PREFIX, SUFFIX, MIDDLE))
        sentinels = {m: (1, marks.index(m), marks.index(m) + len(m)) for m in (PREFIX, SUFFIX, MIDDLE)}
        sentinel_buffer = memoryview(marks)

        def one(doc, text, start, end, ends, trailing):
            """``ends``: where the words of this document end in the buffer."""
            n = len(ends) + trailing
            raw = text[start:end]
            h = [int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
            plain = PieceTable([text, sentinel_buffer], [(0, start, end)])
            whole_text = bytes(raw)
            if not n or h[2] % 100 >= rate or any(m in whole_text for m in sentinels):
                digest = plain.digest()
                return n, "plain", None, None, digest, digest, whole_text if with_output else None
            form = "spm" if h[3] % 100 < spm_share else "psm"
            cuts = [0 if k == 0 else end - start if k > len(ends) else int(ends[k - 1]) - start for k in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
            pieces = plain.cut(cuts)
            sizes = [_code_points(v) for v in pieces.views()[:2]]
            moved = arrange(pieces, form, sentinels)
            output = b"".join(moved.views())
            return n, form, *sizes, moved.digest(), restore(output, form).digest(), output if with_output else None

        def _code_points(view):
            a = np.frombuffer(view, dtype=np.uint8)
            return int(len(a) - ((a & 0xC0) == 0x80).sum())

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).cast(pa.large_string())
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
            base, stop = int(bounds[0]), int(bounds[-1])
            buffer = memoryview(data)[base:stop] if data is not None else memoryview(b"")
            raw = np.frombuffer(buffer, dtype=np.uint8)
            space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
            bounds = bounds - base
            last = np.zeros(len(raw), dtype=bool)  # last bytes of the documents that have any
            last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
            stops = np.flatnonzero(~space & (last | np.append(space[1:], True))) + 1
            first = np.searchsorted(stops, bounds, side="right")
            rows = [one(doc, buffer, int(a), int(b), stops[i:j], int(b > a and space[b - 1]))
                    for doc, a, b, i, j in zip(ids, bounds[:-1], bounds[1:], first[:-1], first[1:])]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][:7 if with_output else 6]
            names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            struct = pa.StructArray.from_arrays([f.cast(pa.string()) if pa.types.is_binary(f.type) else f for f in fields], names[:len(kinds)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], struct], [*batch.schema.names[:-2], "result"])

    return run


def fill_in_middle(docs: DataFrame, seed: str = "42", rate: int = 50, spm_share: int = 80, keep: list[str] | None = None, with_output: bool = True,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with struct ``fim``: n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256 and, unless ``with_output`` is false, the output itself.

    ``rate`` percent of the documents are arranged, ``spm_share`` percent of these as suffix, prefix, middle.
    """
    kept = list(docs.columns) if keep is None else keep
    out, id_, text = free_names(kept, "fim", "__id", "__text")
    rows = docs.select(*[f"`{c}`" for c in kept], F.col(id_column).cast("string").alias(id_), whole(F.col(text_column)).alias(text))
    fields = FIELDS + (", output: string" if with_output else "")
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(out, T.StructType.fromDDL(fields))])
    return rows.mapInArrow(_transform(seed, rate, spm_share, with_output), schema)


def restored(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with the text rebuilt from an output and its form alone."""

    @F.pandas_udf("string")
    def back(outputs, forms):
        import pandas as pd

        return pd.Series([b"".join(restore(o.encode(), f).views()).decode() if o is not None and f is not None else None for o, f in zip(outputs, forms)], dtype=object)

    return rows.withColumn(to, back(F.col(output), F.col(form)))
