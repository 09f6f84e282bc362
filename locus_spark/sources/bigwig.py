"""bigWig files as a Spark data source: runs (chr, st, ed, value).

``spark.dataSource.register(BigWigSource)``, then
``spark.read.format("bigwig").load(path)``. The header, chromosome tree and index are
read when the scan is planned, and with the option ``chr`` only the blocks of that
chromosome are dealt out; every task decodes its own share of the data blocks.
Files are opened as local paths on the workers: they belong on a shared mount. Blocks of
all three kinds (runs, variable and fixed step) and both byte orders are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
BIGWIG, CHROM_TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BLOCKS_PER_TASK = 256


class _File:
    def __init__(self, path: str):
        self.f = open(path, "rb")  # noqa: SIM115
        magic = self.f.read(4)
        self.order = "<" if struct.unpack("<I", magic)[0] == BIGWIG else ">"
        if struct.unpack(self.order + "I", magic)[0] != BIGWIG:
            raise ValueError(f"{path} is no bigWig file")
        _, _, self.tree, _, self.index, _, _, _, _, self.buffer, _ = self.get("HHQQQHHQQIQ")

    def get(self, kinds: str, at: int | None = None) -> tuple:
        if at is not None:
            self.f.seek(at)
        return struct.unpack(self.order + kinds, self.f.read(struct.calcsize(self.order + kinds)))

    def chromosomes(self) -> dict[int, tuple[str, int]]:
        magic, _, key, _, _, _ = self.get("IIIIQQ", self.tree)
        if magic != CHROM_TREE:
            raise ValueError("no chromosome tree")
        found, todo = {}, [self.tree + 32]
        while todo:
            leaf, _, n = self.get("BBH", todo.pop())
            for _ in range(n):
                name = self.f.read(key).rstrip(b"\0").decode()
                if leaf:
                    number, size = self.get("II")
                    found[number] = (name, size)
                else:
                    todo.append(self.get("Q")[0])
        return found

    def blocks(self) -> list[tuple[int, int, int, int]]:
        """(first chromosome, last chromosome, place, size) of all data blocks."""
        if self.get("I", self.index)[0] != INDEX:
            raise ValueError("no index")
        found, todo = [], [self.index + 48]
        while todo:
            leaf, _, n = self.get("BBH", todo.pop())
            for _ in range(n):
                first, _, last, _, place = self.get("IIIIQ")
                if leaf:
                    found.append((first, last, place, self.get("Q")[0]))
                else:
                    todo.append(place)
        return sorted(found, key=lambda b: b[2])

    def runs(self, place: int, size: int) -> Iterator[tuple[int, int, int, float]]:
        self.f.seek(place)
        data = self.f.read(size)
        data = zlib.decompress(data) if self.buffer else data
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(self.order + "IIIIIBBH", data)
        shape = self.order + {1: "IIf", 2: "If", 3: "f"}[kind]
        for k, item in enumerate(struct.iter_unpack(shape, data[24 : 24 + n * struct.calcsize(shape)])):
            if kind == 1:
                yield chrom, item[0], item[1], item[2]
            elif kind == 2:
                yield chrom, item[0], item[0] + span, item[1]
            else:
                yield chrom, start + k * step, start + k * step + span, item[0]


class _Share(InputPartition):
    def __init__(self, blocks: list[tuple[int, int, int, int]], names: dict[int, str]):
        self.blocks, self.names = blocks, names


class BigWigReader(DataSourceReader):
    def __init__(self, path: str, only: str | None):
        self.path, self.only = path, only

    def partitions(self):
        file = _File(self.path)
        names = {k: v[0] for k, v in file.chromosomes().items()}
        wanted = {k for k, v in names.items() if self.only in (None, v)}
        blocks = [b for b in file.blocks() if any(b[0] <= k <= b[1] for k in wanted)]
        return [_Share(blocks[at : at + BLOCKS_PER_TASK], names) for at in range(0, len(blocks), BLOCKS_PER_TASK)] or [_Share([], names)]

    def read(self, partition):
        file = _File(self.path)
        for _, _, place, size in partition.blocks:
            for chrom, st, ed, value in file.runs(place, size):
                if self.only in (None, partition.names[chrom]):  # blocks may span chromosomes
                    yield partition.names[chrom], st, ed, float(value)


class BigWigSource(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return "chr string, st bigint, ed bigint, value double"

    def reader(self, schema):
        return BigWigReader(self.options["path"], self.options.get("chr"))


def write_bigwig(rows: list[tuple[str, int, int, float]], sizes: dict[str, int], path: str, block: int = 512) -> None:
    """A small sorted track as a bigWig file without zoom levels, for export and tests."""
    names = sorted(sizes)
    key = max(map(len, names))
    out = bytearray(64)
    tree = len(out)
    out += struct.pack("<IIIIQQ", CHROM_TREE, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    for k, name in enumerate(names):
        out += name.encode().ljust(key, b"\0") + struct.pack("<II", k, sizes[name])
    data, leaves = len(out), []
    groups: list[list[tuple[str, int, int, float]]] = []
    for row in sorted(rows):
        if not groups or groups[-1][0][0] != row[0] or len(groups[-1]) >= block:
            groups.append([])
        groups[-1].append(row)
    out += struct.pack("<Q", len(groups))
    longest = 0
    for g in groups:
        c = names.index(g[0][0])
        raw = struct.pack("<IIIIIBBH", c, g[0][1], g[-1][2], 0, 0, 1, 0, len(g)) + b"".join(struct.pack("<IIf", s, e, v) for _, s, e, v in g)
        packed = zlib.compress(raw)
        leaves.append((c, g[0][1], c, g[-1][2], len(out), len(packed)))
        longest = max(longest, len(raw))
        out += packed
    index = len(out)
    out += struct.pack("<IIQIIIIQII", INDEX, max(1, len(leaves)), len(rows), 0, 0, len(names), 0, len(out), 1, 0)
    out += struct.pack("<BBH", 1, 0, len(leaves)) + b"".join(struct.pack("<IIIIQQ", *leaf) for leaf in leaves)
    struct.pack_into("<IHHQQQHHQQIQ", out, 0, BIGWIG, 4, 0, tree, data, index, 0, 0, 0, 0, longest, 0)
    with open(path, "wb") as f:
        f.write(out)
