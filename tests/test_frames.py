"""Frame files in batches and on a stream that is stopped and started again."""

import pytest

from lumenframe.sources.frames import FrameFiles


def put(folder, source, frames):
    (folder / source).mkdir(exist_ok=True)
    for f in frames:
        (folder / source / f"{f:06d}.jpg").write_bytes(b"%d" % f * (f % 3))


def test_frames_as_files_and_stream(spark, tmp_path):
    spark.dataSource.register(FrameFiles)
    folder = tmp_path / "in"
    folder.mkdir()
    read = lambda: spark.read.format("frame_files").option("perTask", 3).load(str(folder))
    assert read().count() == 0
    put(folder, "gate", range(7))
    put(folder, "door", [5, 9])
    (folder / "gate" / "notes.txt").write_text("no frame")
    (folder / "gate" / ".000099.jpg").write_text("hidden")

    def rows(frame):
        return sorted((r.source, r.frame, r.size, bytes(r.content)) for r in frame.collect())

    def drain():
        stream = spark.readStream.format("frame_files").load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")

    files = [(p.parent.name, int(p.stem), len(p.read_bytes()), p.read_bytes()) for p in folder.glob("*/0*.jpg")]
    assert rows(read()) == sorted(files) and rows(drain()) == sorted(files)
    put(folder, "gate", [7, 8])
    put(folder, "yard", [1])
    files = [(p.parent.name, int(p.stem), len(p.read_bytes()), p.read_bytes()) for p in folder.glob("*/0*.jpg")]
    assert rows(drain()) == sorted(files)  # only what is new was read: every frame is there once
    assert rows(drain()) == sorted(files)


def test_no_folder(spark, tmp_path):
    spark.dataSource.register(FrameFiles)
    with pytest.raises(Exception, match="No such file"):
        spark.read.format("frame_files").load(f"{tmp_path}/none").collect()
