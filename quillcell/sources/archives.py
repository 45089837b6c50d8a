"""Detection and streaming extraction of compressed inputs.

Files are looked at through Hadoop, so any store that Spark reads will do. gzip and bzip2 text is
read by Spark itself. Zip and tar have no splittable reader; one task streams the members to the
shared folder in small pieces, and Spark reads those (in stores that Arrow can open).
"""

from __future__ import annotations

import bz2
import gzip
import os
import shutil
import tarfile
import zipfile
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import SparkSession

from quillcell.operators.filters import MatrixError
from quillcell.session import file_system, qualified, scratch_path
from quillcell.sources.matrices import MTX_FILES

# Magic bytes of the accepted containers.
MAGIC = ((b"\x1f\x8b", "gzip"), (b"PK\x03\x04", "zip"), (b"BZh", "bzip2"))
_PIECE = 1 << 20
#: Enough compressed bytes for the first block of a tar file.
_HEAD = 1 << 14


def _uri(path: str) -> str:
    """A path as a URI; one without a scheme is taken from the working folder."""
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def _open(path: str):
    system, local = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(local)


def head(path: str, size: int = 1024) -> bytes:
    """The first bytes of a file in any store that Hadoop can open."""
    system, where = file_system(path)
    stream = system.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def check_not_empty(path: str) -> None:
    if not head(path, 1):
        raise MatrixError("the file is empty")


def container(path: str) -> str:
    """gzip, zip, bzip2, tar or text."""
    start = head(path, _HEAD)
    for magic, kind in MAGIC:
        if start.startswith(magic):
            if kind == "gzip" and _is_gzipped_tar(start):
                return "tar"
            return kind
    return "tar" if start[257:262] == b"ustar" else "text"


def _is_gzipped_tar(start: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(start, 512)[257:262] == b"ustar"
    except zlib.error:
        return False


def _extract(path: str, kind: str, out: str) -> list[str]:
    system, root = fs.FileSystem.from_uri(_uri(out))
    system.create_dir(root, recursive=True)

    def save(name: str, stream) -> str:
        with system.open_output_stream(f"{root}/{name}") as sink:
            shutil.copyfileobj(stream, sink, _PIECE)
        return name

    source = _open(path)
    if kind == "tar":
        names = []
        with tarfile.open(fileobj=source, mode="r|*") as tar:
            for member in tar:
                if member.isfile():
                    base = member.name.rsplit("/", 1)[-1]
                    if base not in MTX_FILES:
                        raise MatrixError(f"unexpected member in the archive: {base}")
                    names.append(save(base, tar.extractfile(member)))
        if sorted(names) != sorted(MTX_FILES):
            raise MatrixError(f"the archive must hold {', '.join(MTX_FILES)}")
        return names
    if kind == "zip":
        with zipfile.ZipFile(source) as z:
            if len(z.namelist()) != 1:
                raise MatrixError("the zip file must hold exactly one file")
            with z.open(z.namelist()[0]) as member:
                return [save("input.mat", member)]
    opener = gzip.GzipFile(fileobj=source) if kind == "gzip" else bz2.BZ2File(source)
    return [save("input.mat", opener)]


def unpack(spark: SparkSession, path: str) -> tuple[str, str]:
    """``(kind, readable path)``: text as it is, everything else streamed to the shared folder.

    A corrupt stream fails the task, which is the integrity check.
    """
    path = qualified(path)
    check_not_empty(path)
    kind = container(path)
    if kind == "text":
        return kind, path
    if (kind == "gzip" and path.endswith(".gz")) or (kind == "bzip2" and path.endswith(".bz2")):
        return kind, path
    out = scratch_path(spark, "unpacked")

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                yield pd.DataFrame({"name": _extract(p, kind, out)})

    spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(run, "name string").collect()
    return kind, out if kind == "tar" else f"{out}/input.mat"
