"""Readers keep the order of lines; tables are published once for each setting."""

import gzip
import io
import itertools
import struct
import zlib

import numpy as np
import pytest

from tessella.sources import dataset, h5ad, hdf5, hdf5_parts, matlab, store, text


def test_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = text.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r["line_no"] == int(r["value"]) for r in got)


def test_matrix_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5, 1.0]) for i in range(20)], "cell_id bigint, x array<double>")
    text.write_matrix(df.repartition(5), str(tmp_path / "m"), ["a", "b", "c"])
    back = text.read_matrix(spark, str(tmp_path / "m/rows"))
    assert {r["cell_id"]: r["x"] for r in back.collect()} == {r["cell_id"]: r["x"] for r in df.collect()}
    assert text.read_header(spark, str(tmp_path / "m/header")) == ["a", "b", "c"]


def test_matrix_with_header_and_ragged_rows(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n1,2\n3,4\n")
    assert [r["x"] for r in text.read_matrix(spark, str(tmp_path / "h.csv"), header=True).orderBy("cell_id").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "r.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="ragged row 1"):
        text.read_matrix(spark, str(tmp_path / "r.csv")).collect()


def test_dictionary_labels_and_basis(spark, tmp_path):
    with gzip.open(tmp_path / "d.tsv.gz", "wt") as f:
        f.write("e1\ta\textra\ne2\tb\textra\n")
    assert [tuple(r) for r in text.read_dictionary(spark, str(tmp_path / "d.tsv.gz")).orderBy("line_no").collect()] == [(0, "e1", "a"), (1, "e2", "b")]
    (tmp_path / "l.txt").write_text("3\n0\n7\n")
    assert [r["label"] for r in text.read_labels(spark, str(tmp_path / "l.txt")).orderBy("cell_id").collect()] == [3, 0, 7]
    np.save(tmp_path / "b.npy", np.eye(3))
    np.savetxt(tmp_path / "b.txt", np.eye(3), delimiter=",")
    assert (text.read_basis(str(tmp_path / "b.npy")) == text.read_basis(str(tmp_path / "b.txt"))).all()


def test_published_once_for_each_setting(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert store.published(spark, str(tmp_path), "t", {"n": n}, lambda n=n: make(n)).count() == n
    assert made == [3, 4]
    assert store.first_existing(spark, [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path)
    assert store.missing(spark, [str(tmp_path / "no"), str(tmp_path)]) == [str(tmp_path / "no")]


def test_temporary_folders_go_with_the_application(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(store.temporary(spark, "t"))
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert system.exists(path) and system.cancelDeleteOnExit(path) and system.delete(path, True)


def test_csv_with_an_index(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",celltype,n\nc.1,Ast,3\nc.2,,4\n")
    rows = text.read_indexed(spark, str(tmp_path / "m.csv"), "celltype string, n int")
    assert [tuple(r) for r in rows.orderBy("cell_key").collect()] == [("c.1", "Ast", 3), ("c.2", None, 4)]
    text.write_csv(rows.repartition(3), str(tmp_path / "out"), index="cell_key")
    back = text.read_indexed(spark, str(tmp_path / "out"), "celltype string, n int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "t.csv").write_text(",n\na,1\na,2\n")
    with pytest.raises(ValueError, match="the key a stands 2 times"):
        text.read_indexed(spark, str(tmp_path / "t.csv"), "n int")
    text.write_csv(rows.select("n"), str(tmp_path / "plain"), header=False)
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "plain")).collect()) == ["3", "4"]


def mat_element(kind, content, order):
    return struct.pack(order + "II", kind, len(content)) + content + bytes(-len(content) % 8)


def mat_matrix(name, values, order="<", kind=9, flags=6, small=False):
    shape = np.asarray(values.shape, order + "i4").tobytes()
    label = struct.pack(order + "I", len(name) << 16 | 1) + name.ljust(4, b"\0") if small else mat_element(1, name, order)
    body = mat_element(6, struct.pack(order + "II", flags, 0), order) + mat_element(5, shape, order) + label
    return mat_element(14, body + mat_element(kind, values.astype(order + matlab.TYPES[kind]).tobytes(order="F"), order), order)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_matlab_files(tmp_path, order, packed):
    a, b = np.arange(6.0).reshape(2, 3) / 4, np.arange(8).reshape(4, 2)
    parts = [mat_matrix(b"text", np.ones((1, 2)), order, 4, flags=4), mat_matrix(b"R", a, order, small=True), mat_matrix(b"labels", b, order, 2, flags=9)]
    if packed:
        parts = [struct.pack(order + "II", 15, len(zlib.compress(p))) + zlib.compress(p) for p in parts]
    mark = b"IM" if order == "<" else b"MI"
    (tmp_path / "r.mat").write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack(order + "H", 0x0100) + mark + b"".join(parts))
    assert (text.read_basis(str(tmp_path / "r.mat")) == a).all()
    assert (matlab.read_mat(str(tmp_path / "r.mat"), "labels") == b).all()
    with pytest.raises(KeyError, match="no numeric matrix other"):
        matlab.read_mat(str(tmp_path / "r.mat"), "other")


# HDF5 laid down by hand, in both kinds of headers: what is read here doesn't come from the library's own writer.

NOWHERE = 2**64 - 1


def pad8(b):
    return b + bytes(-len(b) % 8)


class Bytes:
    """A file of version 2 headers and compact links, or of version 1 headers and symbol tables."""

    def __init__(self, old):
        self.old, self.data = old, bytearray(96 if old else 48)

    def put(self, b):
        at = len(self.data)
        self.data += pad8(b)
        return at

    def header(self, messages):
        if not self.old:
            # The second half of the messages stands in a continuation block.
            said = [struct.pack("<BHB", k, len(c), 0) + c for k, c in messages]
            rest = b"".join(said[1:])
            more = self.put(b"OCHK" + rest + b"crc4")
            first = said[0] + struct.pack("<BHBQQ", 16, 16, 0, more, len(rest) + 8)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(first)) + first + b"crc4")
        said = [struct.pack("<HHBxxx", k, len(pad8(c)), 0) + pad8(c) for k, c in messages]
        rest = b"".join(said[1:])
        more = self.put(rest)
        first = said[0] + struct.pack("<HHBxxxQQ", 16, 16, 0, more, len(rest))
        return self.put(struct.pack("<BxHIIxxxx", 1, len(said) + 1, 1, len(first)) + first)

    def attribute(self, name, value):
        kind, data = struct.pack("<BBBBI", 0x13, 0, 0, 0, len(value)), value
        space = struct.pack("<BBBxxxxx", 1, 0, 0) if self.old else struct.pack("<BBBB", 2, 0, 0, 0)
        name += b"\0"
        if self.old:
            return 12, struct.pack("<BxHHH", 1, len(name), len(kind), len(space)) + pad8(name) + pad8(kind) + pad8(space) + data
        return 12, struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + data

    def group(self, members, **attributes):
        told = [self.attribute(k.encode(), v) for k, v in attributes.items()]
        if not self.old:
            links = [(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)) for n, at in members.items()]
            return self.header([(2, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), *links, *told])
        names, at = bytearray(8), {}
        for n in sorted(members):
            at[n] = len(names)
            names += pad8(n.encode() + b"\0")
        space = self.put(bytes(names))
        heap = self.put(struct.pack("<4sBxxxQQQ", b"HEAP", 0, len(names), 1, space))
        leaves = [self.put(struct.pack("<4sBxH", b"SNOD", 1, 1) + struct.pack("<QQ24x", at[n], members[n])) for n in at]
        keys = b"".join(struct.pack("<QQ", 0, leaf) for leaf in leaves) + struct.pack("<Q", 0)
        tree = self.put(struct.pack("<4sBBHQQ", b"TREE", 0, 0, len(leaves), NOWHERE, NOWHERE) + keys)
        return self.header([(17, struct.pack("<QQ", tree, heap)), *told])

    def dataset(self, values, kind, sides=None, filters=(), missing=()):
        """Contiguous, or in chunks under a tree of two levels."""
        rank = values.ndim
        space = struct.pack(f"<BBBxxxxx{rank}Q", 1, rank, 0, *values.shape) if self.old else struct.pack(f"<BBBB{rank}Q", 2, rank, 0, 1, *values.shape)
        if sides is None:
            return self.header([(1, space), (3, kind), (8, struct.pack("<BBQQ", 3, 1, self.put(values.tobytes()), values.nbytes))])
        size, chunks = values.itemsize, []
        for o in itertools.product(*(range(0, n, s) for n, s in zip(values.shape, sides, strict=True))):
            if o in missing:
                continue
            part = np.zeros(sides, values.dtype)
            own = values[tuple(slice(a, a + s) for a, s in zip(o, sides, strict=True))]
            part[tuple(map(slice, own.shape))] = own
            raw, mask = part.tobytes(), 0
            for k, f in enumerate(filters):
                if f == 1 and len(chunks) % 3 == 2:
                    mask |= 1 << k  # a chunk that deflate was left out for
                elif f == 1:
                    raw = zlib.compress(raw)
                elif f == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes()
                elif f == 3:
                    raw += b"sum4"
            chunks.append((len(raw), mask, o, self.put(raw)))
        key = lambda s, m, o: struct.pack(f"<II{rank + 1}Q", s, m, *o, 0)
        last = key(0, 0, values.shape)
        node = lambda level, own, end: self.put(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(own), NOWHERE, NOWHERE) + b"".join(key(s, m, o) + struct.pack("<Q", at) for s, m, o, at in own) + end)
        leaves = []
        for k in range(0, len(chunks), 4):
            own = chunks[k : k + 4]
            leaves.append((*own[0][:3], node(0, own, key(*chunks[k + 4][:3]) if k + 4 < len(chunks) else last)))
        layout = struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, node(1, leaves, last), *sides, size)
        if self.old:
            told = struct.pack("<BBxxxxxx", 1, len(filters)) + b"".join(struct.pack("<HHHHIxxxx", f, 0, 0, 1, size) for f in filters)
        else:
            told = struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHHI", f, 0, 1, size) for f in filters)
        return self.header([(1, space), (3, kind), (8, layout), (11, told)])

    def texts(self, names):
        """Strings of variable size, in a heap of their own."""
        objects = b"".join(struct.pack("<HHxxxxQ", k, 1, len(n)) + pad8(n) for k, n in enumerate(names, 1))
        heap = self.put(b"GCOL" + struct.pack("<BxxxQ", 1, 32 + len(objects)) + objects + bytes(16))
        told = np.frombuffer(b"".join(struct.pack("<IQI", len(n), heap, k) for k, n in enumerate(names, 1)), "V16")
        return self.dataset(told, struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 1, 0, 8))

    def close(self, root):
        if self.old:
            self.data[:96] = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, NOWHERE, len(self.data), NOWHERE) + struct.pack("<QQ24x", 0, root)
        else:
            self.data[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, NOWHERE, len(self.data), root) + b"crc4"
        return bytes(self.data)


def number(code, size, signed=True, big=False):
    if code == "f":
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, 63 if size == 8 else 31, 0, size, 0, 8 * size, *((52, 11, 0, 52, 1023) if size == 8 else (23, 8, 0, 23, 127)))
    return struct.pack("<BBBBIHH", 0x10, (8 if signed else 0) | big, 0, 0, size, 0, 8 * size)


def annotated(x, old, layout):
    """An .h5ad file with x as dense, csr or csc."""
    out = Bytes(old)
    if layout == "dense":
        matrix = out.dataset(x.astype("<f4"), number("f", 4), (64, 3), (2, 1))
    else:
        own = x if layout == "csr" else x.T
        i, j = np.nonzero(own)
        parts = {"data": out.dataset(own[i, j].astype(">f8"), number("f", 8, big=True), (100,), (2, 1, 3)), "indices": out.dataset(j.astype("<u2"), number("i", 2, signed=False), (77,), (1,)), "indptr": out.dataset(np.searchsorted(i, np.arange(len(own) + 1)).astype("<i8"), number("i", 8))}
        matrix = out.group(parts, **{"encoding-type": f"{layout}_matrix".encode()})
    fixed = np.array([f"c{k}".encode() for k in range(len(x))])
    obs = out.group({"keys": out.dataset(fixed, struct.pack("<BBBBI", 0x13, 1, 0, 0, fixed.itemsize), (512,), (1,))}, _index=b"keys")
    var = out.group({"_index": out.texts([f"gén{k}".encode() for k in range(x.shape[1])])}, _index=b"_index")
    return out.close(out.group({"X": matrix, "obs": obs, "var": var}))


@pytest.mark.parametrize("old", [True, False])
@pytest.mark.parametrize("layout", ["dense", "csr", "csc"])
def test_h5ad_by_ranges(spark, tmp_path, old, layout):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((5_432, 7)) < 0.2, rng.integers(1, 99, (5_432, 7)), 0).astype(float)
    (tmp_path / "d.h5ad").write_bytes(annotated(x, old, layout))
    got = h5ad.read_h5ad(spark, f"file://{tmp_path}/d.h5ad")
    assert got.entries.rdd.getNumPartitions() == (1 if layout == "csc" else 2)
    assert {(r["cell_id"], r["pos"]): r["value"] for r in got.entries.collect()} == {(int(a), int(b)): x[a, b] for a, b in zip(*np.nonzero(x), strict=True)}
    assert [r["feature_name"] for r in got.features.orderBy("pos").collect()] == [f"gén{j}" for j in range(7)]
    assert got.cells.filter("cell_id = 5431").first()["cell_key"] == "c5431" and got.cells.count() == 5_432
    with pytest.raises(Exception, match="has no labels"):
        spark.read.format("h5ad").option("what", "labels").load(str(tmp_path / "d.h5ad"))


@pytest.mark.parametrize("old", [True, False])
def test_only_chunks_of_the_rows_are_read(old, monkeypatch):
    x = np.arange(3000.0).reshape(1000, 3)
    out = Bytes(old)
    where = out.dataset(x, number("f", 8), (10, 2), (2, 1), missing={(20, 0), (990, 2)})
    file = hdf5.File(io.BytesIO(out.close(out.group({"x": where}))))
    expected = x.copy()
    expected[20:30, :2] = 0
    expected[990:, 2] = 0
    unfiltered = hdf5.unfiltered
    seen = []
    monkeypatch.setattr(hdf5, "unfiltered", lambda *a: seen.append(1) or unfiltered(*a))
    for first, end in ((0, 1000), (0, 1), (15, 47), (985, 1000), (7, 7), (999, 2000)):
        seen.clear()
        assert (file["x"][first:end] == expected[first:end]).all()
        assert len(seen) <= 2 * ((min(end, 1000) - 1) // 10 - first // 10 + 1)


def test_hdf5_that_cannot_be_read():
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.File(io.BytesIO(b"x" * 9000))
    out = Bytes(True)
    whole = out.close(out.group({"x": out.dataset(np.zeros(9), number("f", 8), (3,), (7,))}))
    led = bytes(1024) + whole[:24] + struct.pack("<Q", 1024) + whole[32:]  # other bytes come first: addresses count from the superblock's base
    assert hdf5.File(io.BytesIO(led))["x"].shape == (9,)
    file = hdf5.File(io.BytesIO(whole))
    with pytest.raises(ValueError, match="filter 7"):
        file["x"][0:9]
    with pytest.raises(KeyError, match="has no y"):
        file["y"]
    with pytest.raises(ValueError, match="the file ends"):
        hdf5.File(io.BytesIO(whole[:100]))["x"]
    with pytest.raises(ValueError, match="no file system"):
        h5ad.files_at("hdfs://there/d.h5ad")


def test_h5ad_written_and_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    cells = spark.createDataFrame([(10 * k, f"cell é{k}" if k % 7 else None) for k in range(501)], "cell_id bigint, cell_key string")
    features = spark.createDataFrame([(f"g{p}", p) for p in (3, 8, 9, 40)], "feature_name string, pos int")
    places = {(int(c) * 10, int(p)): float(v) for c, p, v in zip(rng.integers(0, 500, 900), rng.choice([3, 8, 9, 40], 900), rng.integers(1, 9, 900), strict=True)}
    entries = spark.createDataFrame([(c, p, v) for (c, p), v in places.items()], "cell_id bigint, pos int, value double")
    data = dataset.DataSet(cells, features, entries)
    path = f"file://{tmp_path}/out"
    for files in (3, 5):  # the second takes the place of the first
        h5ad.write_h5ad(data, path, files=files)
        assert len(list((tmp_path / "out").iterdir())) == files
    back = h5ad.read_h5ad(spark, path)
    assert [r["feature_name"] for r in back.features.orderBy("pos").collect()] == ["g3", "g8", "g9", "g40"]
    assert [r["cell_key"] for r in back.cells.orderBy("cell_id").collect()] == [f"cell é{k}" if k % 7 else "" for k in range(501)]
    place = {3: 0, 8: 1, 9: 2, 40: 3}
    assert {(r["cell_id"], r["pos"]): r["value"] for r in back.entries.collect()} == {(c // 10, place[p]): v for (c, p), v in places.items()}
    h5ad.write_h5ad(dataset.DataSet(cells.limit(0), features, entries), path)
    assert h5ad.read_h5ad(spark, path).cells.count() == 0 and h5ad.read_h5ad(spark, path).features.count() == 4


def test_names_of_features_by_parts(tmp_path, monkeypatch):
    """Names are written and read a bounded number at a time; no task holds them all."""
    monkeypatch.setattr(h5ad, "NAMES", 3)
    names = [f"é{k}" for k in range(10)]
    told = []

    def write(path, lists):
        with open(path, "wb") as sink:
            parts = hdf5_parts.Parts(sink)
            parts.close(parts.group({"obs": h5ad.frame(parts, lists, max(len(n.encode()) for n in names))}, {}))

    write(tmp_path / "a.h5ad", (names[a : a + 3] for a in range(0, 10, 3)))
    for some in h5ad.names_at(str(tmp_path)):
        told.append(some)
    assert max(map(len, told)) <= 3 and sum(told, []) == names
    write(tmp_path / "b.h5ad", h5ad.names_at(str(tmp_path / "a.h5ad")))
    assert sum(h5ad.names_at(str(tmp_path)), []) == 2 * names


def test_many_chunks_under_levels(monkeypatch):
    monkeypatch.setattr(h5ad, "CHUNK", 4)
    sink = io.BytesIO()
    parts = hdf5_parts.Parts(sink)
    x = np.arange(70_000) * 0.5
    column = h5ad.Column(parts, "<f8")
    for piece in np.split(x, [1, 3, 1000, 40_001]):
        column.add(piece)
    parts.close(parts.group({"x": column.close()}, {}))
    file = hdf5.File(io.BytesIO(sink.getvalue()))
    assert all((file["x"][a:b] == x[a:b]).all() for a, b in ((0, 70_000), (255, 258), (16_383, 16_386), (69_999, 70_000)))


def test_entries_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(h5ad, "ENTRIES", 5)
    x = {"indptr": np.array([0, 3, 3, 9, 11]), "indices": np.arange(11), "data": np.r_[0.0, np.ones(10)]}
    parts = list(h5ad.entries_of(x, 0, 4))
    assert len(parts) == 3 and np.concatenate([p[0] for p in parts]).tolist() == [0, 0, 2, 2, 2, 2, 2, 2, 3, 3]
    assert np.concatenate([p[1] for p in h5ad.entries_of(x, 2, 4)]).tolist() == list(range(3, 11))
