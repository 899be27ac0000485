"""Raw-record files: framing, rolling and reading."""

import os

import pytest
from pyspark.sql import functions as F

from linkloom.sources import rawdocs
from linkloom.sources.rawdocs import encode_records, read_rawdocs, write_rawdocs

PAGES = "id long, html string"
# The one-byte length of some of these equals a separator or the end mark.
DOCS = [(i, c * n) for i, (c, n) in enumerate([("a", 30), ("b", 31), ("c", 255), ("d", 256), ("e", 287), ("é𝄞", 23), ("x", 1), ("y", 3000)])]


def _framed(doc_id, html, low_byte=False):
    body = html.encode()
    size = bytes([len(body) % 256]) if low_byte else str(len(body)).encode()
    return b"doc_%d\x1f%b\x1f%b\x1e" % (doc_id, size, body)


def _rolled(records, limit):
    files, current = [], b""
    for record in records:
        if current and len(current) + len(record) > limit:
            files.append(current + b"\x17")
            current = b""
        current += record
    return files + [current + b"\x17"]


def _files(path, prefix="doc_raw_", suffix=".bin"):
    names = [n for n in os.listdir(path) if n.startswith(prefix) and n.endswith(suffix)]
    names.sort(key=lambda n: int(n[len(prefix) : -len(suffix)]))
    assert [int(n[len(prefix) : -len(suffix)]) for n in names] == list(range(len(names)))
    return [open(os.path.join(path, n), "rb").read() for n in names]


def _read(spark, path, **options):
    return sorted((int(r.id[4:]), r.length, r.html) for r in read_rawdocs(spark, path, **options).collect())


WANT = [(i, len(h.encode()), h) for i, h in DOCS]


@pytest.mark.parametrize("mode", ["decimal", "low_byte"])
def test_encode(spark, mode):
    df = spark.createDataFrame([*DOCS, (90, ""), (91, None)], PAGES)
    got = {r.id: bytes(r.record) for r in encode_records(df, mode).collect()}
    assert got == {i: _framed(i, h, mode == "low_byte") for i, h in DOCS}


@pytest.mark.parametrize("mode", ["decimal", "low_byte"])
@pytest.mark.parametrize("limit", [1, 400, 10**6])
def test_one_task_rolls_like_one_writer(spark, tmp_path, mode, limit):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(DOCS[::-1], PAGES).repartition(3)
    write_rawdocs(df, path, max_file_size=limit, length_mode=mode, partitions=1)
    records = [_framed(i, h, mode == "low_byte") for i, h in DOCS]
    assert _files(path) == _rolled(records, limit)
    assert sorted(os.listdir(path)) == sorted(n for n in os.listdir(path) if n.startswith("doc_raw_"))
    assert _read(spark, path, split_size=17 if limit > 1 else 10**6) == WANT


def test_many_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(500).select("id", F.repeat(F.lit("z"), F.col("id").cast("int") + 1).alias("html"))
    write_rawdocs(df, path, max_file_size=5000, partitions=4)
    files = _files(path)
    assert all(len(f) <= 5001 and f.endswith(b"\x17") for f in files)
    ids = [int(r.split(b"\x1f")[0][4:]) for f in files for r in f[:-1].split(b"\x1e")[:-1]]
    assert ids == list(range(500))  # file numbers follow the ids
    write_rawdocs(df, str(tmp_path / "local"), order="local", max_file_size=5000)
    assert _read(spark, path) == _read(spark, str(tmp_path / "local")) == [(i, i + 1, "z" * (i + 1)) for i in range(500)]


def test_uneven_ids_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(400).select(F.when(F.col("id") < 399, F.col("id")).otherwise(10**15).alias("id"), F.lit("h").alias("html"))
    write_rawdocs(df.repartition(5), path, partitions=4)
    files = _files(path)
    assert len(files) == 4
    ids = [int(r.split(b"\x1f")[0][4:]) for f in files for r in f[:-1].split(b"\x1e")[:-1]]
    assert ids == [*range(399), 10**15]


def test_append_overwrite_and_names(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(DOCS, PAGES)
    write_rawdocs(df, path, partitions=1)
    write_rawdocs(df, path, partitions=1)
    assert len(_files(path)) == 2
    write_rawdocs(df, path, partitions=1, file_prefix="p-", file_suffix=".raw")
    assert len(_files(path)) == 2 and len(_files(path, "p-", ".raw")) == 1
    write_rawdocs(df, path, partitions=1, mode="overwrite")
    assert len(_files(path)) == 1 and len(_files(path, "p-", ".raw")) == 1
    assert _read(spark, path) == _read(spark, path, file_prefix="p-", file_suffix=".raw") == WANT
    write_rawdocs(df.limit(0), path, mode="overwrite")
    assert _read(spark, path) == []


@pytest.mark.parametrize("bad", ["\x17", "\x1e", "\x1f"])
def test_separators_in_html(spark, tmp_path, bad):
    df = spark.createDataFrame([(1, f"a{bad}b"), (2, "c")], PAGES)
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="separator byte in the HTML of document 1"):
        write_rawdocs(df, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    write_rawdocs(df, path, on_separator="strip")
    assert _read(spark, path) == [(1, 2, "ab"), (2, 1, "c")]


def test_broken_file_is_reported(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    (path / "doc_raw_0.bin").write_bytes(_framed(1, "a") + b"doc_2\x1f9\x1fcut")
    with pytest.raises(Exception, match="broken record"):
        read_rawdocs(spark, str(path)).collect()


@pytest.mark.parametrize(
    "data", [_framed(1, "a"), _framed(1, "a") + b"\x17x", b"doc_1\x1f99\x1fabc\x1e\x17", b"", _framed(1, "abc" * 50)[:-9] + b"\x17"]
)
@pytest.mark.parametrize("split", [20, 10**6])
def test_damaged_files_are_reported(spark, tmp_path, data, split):
    path = tmp_path / "out"
    path.mkdir()
    (path / "doc_raw_0.bin").write_bytes(data)
    with pytest.raises(Exception, match="broken record|end mark|not as stored"):
        read_rawdocs(spark, str(path), split_size=split).collect()


def test_folders_below_are_read(spark, tmp_path):
    df = spark.createDataFrame(DOCS, PAGES)
    for part in (0, 1):
        write_rawdocs(df.filter(F.col("id") % 2 == part), str(tmp_path / f"raw/run=x/batch={part}"))
    assert _read(spark, str(tmp_path / "raw")) == WANT


class _Breaking:
    """A file system that fails at one of the steps that change something."""

    def __init__(self, steps):
        self.inner, self.steps = rawdocs.fs.LocalFileSystem(), steps

    def __getattr__(self, name):
        call = getattr(self.inner, name)
        if name not in ("move", "delete_file", "delete_dir", "open_output_stream"):
            return call

        def counted(*args, **kwargs):
            self.steps -= 1
            if self.steps < 0:
                raise OSError("the writer is gone")
            return call(*args, **kwargs)

        return counted


def _commit(path, docs, mode="append", part=0):
    writer = rawdocs._Writer({"path": path, "maxfilesize": "40"}, mode == "overwrite")
    os.makedirs(os.path.join(path, writer.staging))
    files = rawdocs._RollingFiles(rawdocs.fs.LocalFileSystem(), f"{path}/{writer.staging}/{part}", 40)
    for i, html in docs:
        record = _framed(i, html)
        files.add(memoryview(record), rawdocs.np.array([len(record)]))
    files.close()
    message = rawdocs._TaskFiles(part, files.names, files.sizes, files.records)
    try:
        writer.commit([message])
    except OSError:
        writer.abort([message])
        raise


def _seen(path):
    reader = rawdocs._Reader({"path": path, "splitsize": "25"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    return sorted((int(i[4:]), h) for b in batches for i, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist()))


@pytest.mark.parametrize("mode", ["append", "overwrite"])
@pytest.mark.parametrize("old, new", [(7, 3), (2, 6), (0, 3), (4, 0)])
def test_a_commit_broken_off_at_any_step_is_whole_or_not_there(tmp_path, monkeypatch, mode, old, new):
    before = [(i, f"old {i} " * 3) for i in range(old)]
    after = [(100 + i, f"new {i} " * 3) for i in range(new)]
    whole = after if mode == "overwrite" else before + after
    outcomes, steps = [], 0
    monkeypatch.setattr(rawdocs, "_RENAMERS", 1)
    while True:
        path = str(tmp_path / f"steps-{steps}")
        os.makedirs(path)
        _commit(path, before)
        with monkeypatch.context() as patch:
            system = _Breaking(steps)
            patch.setattr(rawdocs, "_open_fs", lambda p: (system, p))
            try:
                _commit(path, after, mode)
                finished = True
            except OSError:
                finished = False
        got = _seen(path)
        assert got in (before, whole)
        outcomes.append(got == whole)
        parts = rawdocs._Reader({"path": path}).partitions()
        _commit(path, [(500, "later")])  # carries out what was left
        assert _seen(path) == got + [(500, "later")]
        assert rawdocs._JOURNAL not in os.listdir(path)
        if got == whole and mode == "append":  # ranges planned before the files were moved
            reader = rawdocs._Reader({"path": path})
            assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(got)
        if finished:
            break
        steps += 1
    if before != whole:
        assert outcomes[0] is False and outcomes == sorted(outcomes) and outcomes.count(True) > 1


def test_overwrite_then_append(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(DOCS, PAGES)
    write_rawdocs(df, path, max_file_size=400)
    write_rawdocs(df.filter("id < 3"), path, max_file_size=400, mode="overwrite")
    write_rawdocs(df.filter("id >= 3"), path, max_file_size=400)
    assert _read(spark, path) == WANT
    assert all(n.startswith("doc_raw_") for n in os.listdir(path))


def test_paths_are_shared_ones(spark, tmp_path, monkeypatch):
    assert rawdocs._shared(spark, str(tmp_path)).startswith("file:/")
    assert rawdocs._open_fs("file:" + str(tmp_path))[1] == str(tmp_path)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: "spark://somewhere:7077")

    monkeypatch.setattr(rawdocs, "resolved", lambda _, path: path)
    with pytest.raises(ValueError, match="local folder"):
        rawdocs._shared(Cluster, "file:/corpus")
    assert rawdocs._shared(Cluster, "s3a://corpus/raw") == "s3a://corpus/raw"


def test_wrong_options(spark):
    df = spark.createDataFrame(DOCS, PAGES)
    with pytest.raises(ValueError):
        encode_records(df, "other")
    with pytest.raises(ValueError):
        encode_records(df, on_separator="other")
    with pytest.raises(ValueError):
        write_rawdocs(df, "x", order="other")


def test_shared_work_folder_of_a_cluster(monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod({"spark.master": "spark://somewhere:7077", "spark.checkpoint.dir": "file:/shared/work"}.get)

    monkeypatch.setattr(rawdocs, "resolved", lambda _, path: path)
    assert rawdocs._shared(Cluster, "file:/shared/work/raw") == "file:/shared/work/raw"
    for other in ("file:/shared/workers/raw", "file:/corpus"):
        with pytest.raises(ValueError, match="local folder"):
            rawdocs._shared(Cluster, other)


@pytest.mark.parametrize("mode", ["decimal", "low_byte"])
def test_store_that_only_spark_reaches(spark, tmp_path, mode):
    store = "raws-" + mode.replace("_", "-")  # file systems are kept by name
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./in", f"file:{tmp_path}")
    path = f"viewfs://{store}/in/{mode}/run=x/batch=0"
    df = spark.createDataFrame(DOCS, PAGES)
    write_rawdocs(df, path, max_file_size=600, length_mode=mode, partitions=3)
    write_rawdocs(df, str(tmp_path / "direct"), max_file_size=600, length_mode=mode, partitions=3)
    names = {n for n in os.listdir(tmp_path / "direct") if not n.startswith(".")}
    held = tmp_path / f"{mode}/run=x/batch=0"
    assert len(names) > 3 and {n for n in os.listdir(held) if not n.startswith(".")} == names
    assert all((held / n).read_bytes() == (tmp_path / "direct" / n).read_bytes() for n in names)
    assert _read(spark, f"viewfs://{store}/in/{mode}") == WANT
    write_rawdocs(df.filter("id % 2 = 0"), path, mode="overwrite", length_mode=mode)
    assert _read(spark, path) == [w for w in WANT if w[0] % 2 == 0]
    write_rawdocs(df.filter("id % 2 <> 0"), path, length_mode=mode)
    assert _read(spark, path) == WANT
    write_rawdocs(df.filter("id < 0"), path, mode="overwrite")
    assert _read(spark, path) == []
    with pytest.raises(Exception, match="separator byte in the HTML of document 1"):
        write_rawdocs(spark.createDataFrame([(1, "a\x1fb")], PAGES), path)
    assert not [n for n in os.listdir(held) if n.startswith("_")]
