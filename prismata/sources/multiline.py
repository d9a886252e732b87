"""Records of CSV files whose fields span lines, cut by many tasks.

Whether a line begins inside a quoted field depends on all lines before it, so
each block of a file is cut for both cases in one scan; a row a block tells what
it does with either.  The driver goes through these rows in order, which gives
the case of each block.  Records within a block are then cut where they lie;
those that reach over blocks are put together from their pieces in one shuffle
of these pieces alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import session, small_frame

#: Bytes of records that are sent to the JVM at once.
SENT_BYTES = 4 << 20
#: Bytes at the start of a file that tell how its lines end.
HEAD_BYTES = 1 << 16
#: The place of a record that reaches over blocks: behind the others that begin in its block.
LAST = 1 << 62

_PIECES = "key long, block long, crlf boolean, head binary, closed boolean, tail0 binary, tail1 binary, n0 long, n1 long"
_RECORDS = "key long, block long, at long, record binary"


def patterns(sep: str, end: str) -> tuple[re.Pattern, re.Pattern]:
    """A record from its start, and what is left of one from within a quoted field; as Spark's CSV parser has it, quotes count at the start of a field only, and what follows a closing one belongs to the field."""
    s, e = re.escape({"\\t": "\t"}.get(sep, sep).encode()), re.escape(end.encode())
    plain = b"[^" + s + e + b"]*+" if len(sep.encode()) == 1 else b"(?:(?!" + s + b")[^" + e + b"])*+"
    quoted = b'[^"]*+(?:""[^"]*+)*+"' + plain
    rest = b"(?:" + s + b'(?:"' + quoted + b'|(?!")' + plain + b"))*+" + e
    return re.compile(b'(?:"' + quoted + b'|(?!")' + plain + b")" + rest), re.compile(quoted + rest)


class Cutter:
    """Cuts a block that comes in parts, from the start of a record or from within a field."""

    def __init__(self, sep: str, end: str, inside: bool):
        self.record, self.left = patterns(sep, end)
        self.inside, self.head, self.held, self.size, self.tried = inside, b"", [], 0, 0

    def add(self, text: bytes, last: bool = False) -> list[bytes]:
        """The records that are whole now; an open one is looked at again when it has grown to the double, so that long ones cost no more."""
        self.held.append(text)
        self.size += len(text)
        if self.size < 2 * self.tried and not last:
            return []
        text, at, out = b"".join(self.held), 0, []
        if self.inside and (m := self.left.match(text)):
            self.inside, at, self.head = False, m.end(), m.group()
        if not self.inside:
            while m := self.record.match(text, at):
                out.append(m.group())
                at = m.end()
        self.held, self.size = [text[at:]], len(text) - at
        self.tried = self.size
        return out

    @property
    def tail(self) -> bytes:
        return b"".join(self.held)


def _blocks(batches, end: bytes):
    """((key, block), text) of the lines of each batch, by block."""
    for b in batches:
        keys, blocks = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])).nonzero()[0] + 1, len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                yield (int(keys[low]), int(blocks[low])), end.join(b.column(2).slice(low, high - low).to_pylist()) + end


def _whole(record: bytes) -> bytes:
    """A record without its line's end."""
    return record[:-1].removesuffix(b"\r")


def _bytes(path: str, at: int, n: int) -> bytes:
    """So many bytes of a file, from a place that counts from the end if it is negative."""
    spark = session()
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(file)
    stream.seek(at if at >= 0 else max(0, fs.getFileStatus(file).getLen() + at))
    found = bytes(b & 0xFF for b in stream.readNBytes(n))
    stream.close()
    return found


def line_end(path: str) -> str:
    """What ends the lines of a file: a line feed (perhaps after a carriage return), or a carriage return alone."""
    head = _bytes(path, 0, HEAD_BYTES)
    return "\r" if b"\r" in head and b"\n" not in head else "\n"


def cut_states(rows: list[tuple], header: bool) -> tuple[dict, list[tuple], set]:
    """From (key, block, crlf, closed, open0, open1, n0, n1) of each block: how to cut it, a row for its pieces, and the files that end within a field.

    How to cut it, by (key, block), is whether it begins inside a field, whether
    the first record that begins in it is the header, and whether the file's
    lines end in two characters.  The rows are key, block, inside, the block
    where the record that it begins in began, whether the record that reaches
    beyond the block is the header, and the lines' ends.
    """
    states, out, unended, last, inside, owner, waiting, ends = {}, [], set(), None, False, None, False, False
    for key, block, crlf, closed, open0, open1, n0, n1 in sorted(rows):
        if key != last:
            last, inside, owner, waiting, ends = key, False, None, header, crlf
        n, beyond = (n1, open1) if inside else (n0, open0)
        begins = closed or not inside  # else the field goes on
        first = waiting and begins and n > 0
        dropped = waiting and begins and not first and beyond
        states[key, block] = (inside, first, ends)
        out.append((key, block, inside, owner if inside else None, dropped, ends))
        waiting = waiting and not first and not dropped
        if begins and beyond:
            owner = block
        inside = beyond if begins else True
        (unended.add if inside else unended.discard)(key)
    return states, out, unended


def csv_records(path: str, sep: str, header: bool, most: int) -> tuple[DataFrame, DataFrame, str]:
    """file (its number in order), block, at (place in the block) and record of all records but headers and empty lines; the first ``most`` of them; and what ends lines."""
    spark = session()
    files = sorted(x.replace("file:///", "file:/") for x in spark.read.text(path).inputFiles())
    end = line_end(files[0])
    last = end.encode()
    # the slashes of a local path differ between Spark's interfaces
    key = F.xxhash64(F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")))
    lines = spark.read.text(path, lineSep=end).select(key.alias("key"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def both(batches):
        def row():
            for k in (0, 1):
                counts[k] += sum(len(_whole(x)) > 0 for x in cutters[k].add(b"", True))
            out, inn = cutters
            head, tail1 = (inn.tail, b"") if inn.inside else (inn.head, inn.tail)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            values = (*now, crlf, head, not inn.inside, out.tail, tail1, *counts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["key", "block", "crlf", "head", "closed", "tail0", "tail1", "n0", "n1"])

        now, crlf, cutters, counts = None, False, (), [0, 0]
        for at, text in _blocks(batches, last):
            if at != now:
                if now:
                    yield row()
                now, cutters, counts = at, (Cutter(sep, end, False), Cutter(sep, end, True)), [0, 0]
                crlf = 0 <= text.find(b"\r") == text.find(last) - 1  # that ends the first line
            for k in (0, 1):
                counts[k] += sum(len(_whole(x)) > 0 for x in cutters[k].add(text))
        if now:
            yield row()

    pieces = lines.mapInArrow(both, _PIECES).persist()  # some bytes a block; made again if lost
    told = pieces.select("key", "block", "crlf", "closed", (F.length("tail0") > 0).alias("open0"), (F.length("tail1") > 0).alias("open1"), "n0", "n1").collect()  # a row a block
    states, rows, unended = cut_states([tuple(r) for r in told], header)

    def whole(batches):
        def made():
            nonlocal out, held
            k, b = zip(*[x[:2] for x in out])
            batch = pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())], ["key", "block", "at", "record"])
            out, held = [], 0
            return batch

        def taken(records):
            nonlocal skip, n, held
            for r in map(_whole, records):
                if r:
                    r = r.replace(b"\r\n", b"\n") if crlf else r
                    if not skip:
                        out.append((*now, n, r))
                        held += len(r) + 24
                    skip, n = False, n + 1
                    if held >= SENT_BYTES:
                        yield made()

        now, cutter, skip, crlf, n, out, held = None, None, False, False, 0, [], 0
        for at, text in _blocks(batches, last):
            if at != now:
                if now:
                    yield from taken(cutter.add(b"", True))
                now, (inside, skip, crlf), n = at, states[at], 0
                cutter = Cutter(sep, end, inside)
            yield from taken(cutter.add(text))
        if now:
            yield from taken(cutter.add(b"", True))
        if out:
            yield made()

    numbers = small_frame([(i, x) for i, x in enumerate(files)], "file long, name string").select("file", "name", F.xxhash64("name").alias("key"))
    beyond = None
    if any(r.open1 if states[r.key, r.block][0] else r.open0 for r in told):  # some record reaches over blocks
        ended = {x.key: _bytes(x.name, -1, 1) == last for x in numbers.where(F.col("key").isin(sorted(unended))).collect()} if unended else {}
        parts = pieces.drop("crlf").join(small_frame([(*r, ended.get(r[0], False)) for r in rows], "key long, block long, inside boolean, began long, dropped boolean, crlf boolean, kept boolean"), ["key", "block"])
        head = parts.where("inside").select("key", F.col("began").alias("owner"), "block", F.col("head").alias("piece"), F.lit(False).alias("dropped"), "crlf", "kept")
        tail = parts.where("NOT inside OR closed").select("key", F.col("block").alias("owner"), "block", F.when(F.col("inside"), F.col("tail1")).otherwise(F.col("tail0")).alias("piece"), "dropped", "crlf", "kept").where(F.length("piece") > 0)
        order = F.array_sort(F.collect_list(F.struct("block", F.col("piece").cast("string").alias("piece"))))
        text = F.array_join(F.transform(order, lambda x: x["piece"]), "")
        joined = head.unionByName(tail).groupBy("key", "owner").agg(text.alias("text"), F.max(F.struct("block", "piece"))["block"].alias("end"), F.bool_or("dropped").alias("dropped"), F.first("crlf").alias("crlf"), F.first("kept").alias("kept")).where("NOT dropped")
        # a file that ends within a field keeps its last line's end, if it has one
        ends = small_frame([(k, b) for k, b in {r[0]: r[1] for r in rows}.items() if k in unended], "key long, final long")
        joined = joined.join(F.broadcast(ends), "key", "left")
        cut = F.expr("left(text, length(text) - 1)")
        cut = F.when(F.col("kept") & (F.col("end") == F.col("final")), F.col("text")).when(cut.endswith("\r"), F.expr("left(text, length(text) - 2)")).otherwise(cut)
        cut = F.when(F.col("crlf"), F.replace(cut, F.lit("\r\n"), F.lit("\n"))).otherwise(cut)
        beyond = joined.select("key", F.col("owner").alias("block"), F.lit(LAST).alias("at"), cut.cast("binary").alias("record"))

    def records(lines: DataFrame) -> DataFrame:
        found = lines.mapInArrow(whole, _RECORDS)
        found = found.unionByName(beyond) if beyond is not None else found
        return found.join(F.broadcast(numbers.drop("name")), "key").select("file", "block", "at", F.col("record").cast("string").alias("record"))

    # the first rows lie in the first blocks, as many as hold them
    names, left, before, upto = {r.key: r.file for r in numbers.collect()}, most + header, set(), None
    for r in sorted(told, key=lambda r: (names[r.key], r.block)):
        if left <= 0:
            break
        if upto and upto.key != r.key:
            before.add(upto.key)
            left += header
        upto = r
        left -= r.n1 if states[r.key, r.block][0] else r.n0
    need = F.col("key").isin(sorted(before)) | (F.col("key") == upto.key) & (F.col("block") <= upto.block) if upto else F.lit(False)
    return records(lines), records(lines.where(need)).orderBy("file", "block", "at").limit(most), end
