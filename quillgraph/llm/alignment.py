"""Alignment of two tokenizers' tokens, by relational plans over exploded tokens.

Byte offsets at which a token of A and a token of B both end cut a text into groups. Tokens are exploded with their
places, their lengths are added up in a window, A's and B's tokens meet by the end, the ends they share are counted
as they run, which numbers the groups, and in a group every A token is linked with every B token.

A corpus holds the same words again and again, and both tokenizers always end a token where a space follows a character
that isn't one: A reads pieces that no such place falls into, and no entry of B has a space after another character
(checked when its file is loaded; otherwise a text is one unit). So a text falls apart into units at these places, the
whole plan above runs once for each different unit, and a document's groups are those of its units in order.

Documents are dealt into slices: neighbouring rows of a task, of some million characters. A task numbers the different
units of a slice and gives a row for each of them, and one row with the slice's units in order, as numbers. Units are
shuffled to meet what is known of them, and by slice to come back to their documents. There the units' groups and counts
are put together, slice by slice, and the (document, id pair) rows of which the corpus-wide counts are made are combined
before they are shuffled. A task holds one slice at once; a longer document is a slice of its own.

Defined results: texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros
and an empty groups column; repeated rows are documents of their own; a null id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from . import bpe
from .common import shuffle_partitions
from .prefix_trie import dense

SPACE = "▁"
#: A space after one of these starts a unit: printable ASCII and Latin, Greek, Cyrillic, kana and common Han characters,
#: none of which any library takes for white space
BEFORE = "!-~¡-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞₠-₵ぁ-ゔァ-ヺ一-龥"
SEAM, NO_SEAM = re.compile(f"(?<=[{BEFORE}])(?= )"), re.compile(f"[^{BEFORE}] ")
SLICE = 8 << 20  # characters of a slice
ROUNDS = 4  # in which slices are put together, so that a quarter of their rows lies in shuffle files at once

PAIR = 1 << 32  # a pair of ids is A's times this, and B's
TOKENS = "a_ids array<int>, a_lengths array<int>, b_ids array<int>, b_lengths array<int>, whole boolean"


class Pair:
    """Both tokenizers, for a unit at a time."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = bpe.coder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.b_space = self.b.piece_to_id(SPACE)

    def encode(self, units: list[str]) -> list[tuple]:
        """TOKENS of each unit after a space, which B adds by itself."""
        out = []
        for unit, b_ids in zip(units, self.b.encode(units, num_threads=1), strict=True):
            raw = b" " + unit.encode()
            a_ids = self.a.encode_plain(" " + unit)
            b_ids = b_ids or [self.b_space]
            a_bytes, b_bytes = [self.a.quick.decode_single_token_bytes(i) for i in a_ids], [self.b_bytes[i] for i in b_ids]
            out.append((a_ids, [len(x) for x in a_bytes], b_ids, [len(x) for x in b_bytes], b"".join(a_bytes) == raw == b"".join(b_bytes)))
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def splits_at_spaces(path_b: str) -> bool:
    """Whether no entry of B has a space after another character."""
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    return not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in b.id_to_piece(list(range(b.get_piece_size()))))


def tokenized(units: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """units (u, unit) with TOKENS in place of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path_a, path_b
        if key not in _pairs:
            _pairs[key] = Pair(*key)
        ints = pa.list_(pa.int32())
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                columns = zip(*_pairs[key].encode(part.column(1).to_pylist()), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, (ints, ints, ints, ints, pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["u", "a_ids", "a_lengths", "b_ids", "b_lengths", "whole"])

    return units.select("u", "unit").mapInArrow(run, f"u long, {TOKENS}")


def units_of(text: str, split: bool) -> list[str]:
    """The units of a text without the space that each starts with."""
    if not split:
        return [text]
    if NO_SEAM.search(text) is None and not text.startswith(" "):
        return text.split(" ")
    return [u[1:] for u in SEAM.split(" " + text)]


#: ids and units are a slice's documents and units in order, as packed numbers: rows with arrays of that size are slow to
#: pass on to Python, and so are all rows beside them
SLICED = "slice long, number int, unit string, ids binary, units binary"
NO_ID = -(1 << 63)


def sliced(docs: DataFrame, split: bool) -> DataFrame:
    """SLICED rows: the different units of each slice, without their space, with their numbers; and a row for each slice with
    its documents' ids and all its units in order, as numbers, each document's after a -1."""

    def rows(start: int, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        names: dict[str, int] = {}
        flat: list[int] = []
        for text in texts:
            flat.append(-1)
            if text:
                flat += [names.setdefault(u, len(names)) for u in units_of(text, split)]
        n = len(names)
        whole = lambda values, kind: pa.array([np.array(values, kind).tobytes(), *[None] * n], pa.binary())
        number = pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(np.arange(n, dtype=np.int32))])
        columns = [pa.array(np.full(n + 1, start)), number, pa.array([None, *names], pa.string()), whole([NO_ID if i is None else i for i in ids], "<i8"), whole(flat, "<i4")]
        return pa.RecordBatch.from_arrays(columns, ["slice", "number", "unit", "ids", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, ids, texts, size = 0, [], [], 0
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                if ids and size + len(text or "") > SLICE:
                    yield rows(start, ids, texts)
                    ids, texts, size = [], [], 0
                if not ids:
                    start = row
                ids.append(doc)
                texts.append(text)
                size += len(text or "") + 1
        if ids:
            yield rows(start, ids, texts)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, SLICED)


def ends(tokens: DataFrame) -> DataFrame:
    """(u, side, pos, id, n, end): the tokens of A (side 0) and of B (1) with the byte at which each one ends."""

    def of(side: int, name: str) -> Column:
        each = F.arrays_zip(F.col(f"{name}_ids").alias("id"), F.col(f"{name}_lengths").alias("n"))
        return F.transform(each, lambda t, pos: F.struct(F.lit(side).alias("side"), pos.alias("pos"), t["id"].alias("id"), t["n"].alias("n")))

    rows = tokens.select("u", F.explode(F.concat(of(0, "a"), of(1, "b"))).alias("t")).select("u", "t.*")
    return rows.withColumn("end", F.sum("n").over(Window.partitionBy("u", "side").orderBy("pos")))


def grouped(tokens: DataFrame) -> DataFrame:
    """(u, g, a, b): the ids of A and of B in each group, in order; groups are counted from 0 within the unit. Tokens are dealt by
    unit once; all that follows finds them so, and in the order of their ends."""
    at, before = Window.partitionBy("u", "end"), Window.partitionBy("u").orderBy("end").rangeBetween(Window.unboundedPreceding, -1)
    rows = ends(tokens).withColumn("cut", F.when((F.min("side").over(at) == 0) & (F.col("side") == 1), 1))
    rows = rows.withColumn("g", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    of = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id")))), lambda t: t["id"])
    return rows.groupBy("u", "g").agg(of(0).alias("a"), of(1).alias("b"))


def unit_groups(groups: DataFrame) -> DataFrame:
    """(u, n_a, n_b, n_groups, n_links, groups, links): the counts of each unit, its groups as text, and the id pairs that are
    linked in each group with how often, (pair, n). groups: as grouped()."""
    counted = lambda ids: F.transform(F.array_distinct(ids), lambda i: F.struct(i.cast("long").alias("id"), (F.size(ids) - F.size(F.array_remove(ids, i))).cast("long").alias("n")))
    each = groups.select(
        "u", "g", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), counted(F.col("a")).alias("ca"), counted(F.col("b")).alias("cb"),
        F.concat_ws("|", *[F.array_join(F.col(c).cast("array<string>"), ",") for c in ("a", "b")]).alias("both"),
    )
    links = F.flatten(F.transform("ca", lambda x: F.transform("cb", lambda y: F.struct((x["id"] * PAIR + y["id"]).alias("pair"), (x["n"] * y["n"]).alias("n")))))
    return each.withColumn("links", links).groupBy("u").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.col("n_a") * F.col("n_b")).alias("n_links"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "both"))), lambda x: x["both"]), ";").alias("groups"), F.flatten(F.collect_list("links")).alias("links"),
    )


def _documents(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a slice: the documents' ids, whether each has tokens at all, and for every unit in order its row and
    its document."""
    number = t.column("number").combine_chunks()
    at = int(np.flatnonzero(number.is_null())[0])
    row_of = np.zeros(t.num_rows, np.int64)  # by the unit's number
    known = np.flatnonzero(number.is_valid())
    row_of[number.drop_null().to_numpy()] = known
    units = np.frombuffer(t.column("units")[at].as_py(), "<i4")
    ids = np.frombuffer(t.column("ids")[at].as_py(), "<i8")
    ids = pa.array(ids, mask=ids == NO_ID)
    head = units < 0
    row, doc = row_of[units[~head]], np.cumsum(head)[~head] - 1
    whole = np.ones(len(ids), bool)
    whole[doc[~t.column("whole").combine_chunks().to_numpy(zero_copy_only=False)[row]]] = False
    return ids, whole, row, doc


def _held(t: pa.Table) -> pa.Table:
    """(pair, held): how many of a slice's documents hold each id pair linked."""
    _, whole, row, doc = _documents(t)
    row, doc = row[whole[doc]], doc[whole[doc]]
    some = np.unique(doc * t.num_rows + row)
    doc, row = some // t.num_rows, some % t.num_rows
    lists = t.column("pairs").combine_chunks()
    offsets = lists.offsets.to_numpy()
    pairs, local = np.unique(lists.values.to_numpy(), return_inverse=True)
    n = lists.value_lengths().fill_null(0).to_numpy()[row]
    at = np.repeat(offsets[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
    held = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + local[at]) % max(1, len(pairs))
    count = np.bincount(held, minlength=len(pairs))
    return pa.table({"pair": pa.array(pairs[count > 0], pa.int64()), "held": pa.array(count[count > 0], pa.int64())})


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _assembled(t: pa.Table) -> pa.Table:
    """The documents of a slice, from what is known of their units."""
    ids, whole, row, doc = _documents(t)
    row, doc = row[whole[doc]], doc[whole[doc]]
    groups = t.column("groups").to_pylist()
    size = np.bincount(doc, minlength=len(ids))
    ends = np.cumsum(size)
    out = {"doc_id": ids}
    for c in COUNTS:
        running = np.concatenate([[0], np.cumsum(t.column(c).combine_chunks().fill_null(0).to_numpy()[row])])
        out[c] = pa.array(running[ends] - running[ends - size], pa.int64())
    rows = row.tolist()
    texts = (";".join([groups[r] for r in rows[e - n : e]]) for e, n in zip(ends.tolist(), size.tolist(), strict=True))
    out["groups_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts])
    return pa.table(out)


def by_slice(rows: DataFrame, make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What make() gives of each slice's rows, which come together and one slice after the other."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else []
            start = 0
            for end in ends:
                if open_ and open_[-1].column(0)[0].as_py() != at[start]:
                    yield from make(pa.Table.from_batches(open_)).to_batches()
                    open_ = []
                open_.append(b.slice(start, end - start))
                start = end
        if open_:
            yield from make(pa.Table.from_batches(open_)).to_batches()

    parts = 4 * shuffle_partitions(rows.sparkSession)
    return rows.select("slice", *[c for c in columns if c != "slice"]).repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.write(sliced(docs, splits_at_spaces(path_b)), "align-units")
    names = dense(found.where("unit IS NOT NULL").select("unit").distinct(), "u", "align-unit-names")
    tokens = scratch.write(tokenized(names, path_a, path_b), "align-tokens")

    stands = scratch.write(found.where("unit IS NOT NULL").select("slice", "number", "unit").join(names, "unit").drop("unit"), "align-stands")
    heads = scratch.write(found.where("unit IS NULL").select("slice", "ids", "units"), "align-slices")
    scratch.drop(found)

    def told(known: DataFrame, make: Callable[[pa.Table], pa.Table], schema: str, sums: str | None = None) -> DataFrame:
        """What make() gives of the rows of each slice, its units with what is known of them; a number added up by `sums`."""
        out = None
        for k in range(ROUNDS):
            now = F.pmod(F.xxhash64("slice"), F.lit(ROUNDS)) == k
            rows = stands.where(now).join(known, "u").drop("u").unionByName(heads.where(now), allowMissingColumns=True)
            made = by_slice(rows.withColumn("whole", F.coalesce("whole", F.lit(True))), make, schema)
            made = scratch.write(made.groupBy(sums).agg(F.sum("held").alias("held")) if sums else made, "align-round")
            out = made if out is None else out.unionByName(made)
        return out.groupBy(sums).agg(F.sum("held").alias("held")) if sums else out

    units = scratch.write(unit_groups(grouped(tokens.where("whole").repartition(4 * shuffle_partitions(spark), "u"))), "align-texts")
    of_unit = units.select("u", F.array_distinct("links.pair").alias("pairs"))
    of_unit = scratch.write(tokens.select("u", "whole").join(of_unit, "u", "left"), "align-unit-pairs")
    pairs = scratch.write(told(of_unit, _held, "pair long, held long", "pair").withColumn("a", F.shiftright("pair", 32)), "align-held")
    scratch.drop(of_unit)
    most = pairs.groupBy("a").agg(F.max("held").alias("most"))
    pairs = pairs.join(most, "a").select("pair", "held", (F.col("held") == F.col("most")).cast("long").alias("best"))
    links = units.select("u", F.explode("links").alias("l")).select("u", "l.pair", "l.n")
    scores = links.join(pairs, "pair").groupBy("u").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("held")).alias("count_sum"))
    scores = scratch.write(scores, "align-scores")
    known = scratch.write(tokens.select("u", "whole").join(units.drop("links").join(scores, "u"), "u", "left"), "align-known")
    scratch.drop(units, scores, tokens)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
    return told(known, _assembled, schema)
