"""Image volumes: raw, TIFF (uncompressed), MHD, NRRD, NIfTI and Analyze headers and pixels, and long tables of them.

Files are read with Spark's ``binaryFile`` and decoded in Arrow batches, one file at a
time; the catalog is filtered before a byte is read.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: type names of the formats
NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "short": "i2", "short int": "i2", "int16": "i2", "int16_t": "i2",
    "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4",
    "longlong": "i8", "long long": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "unsigned long long": "u8", "uint64": "u8", "uint64_t": "u8", "float": "f4", "double": "f8",
}
MET_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def read_tiff(raw: bytes) -> np.ndarray:
    """(pages, rows, columns) of an uncompressed or deflated grey TIFF in strips."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack(order + "I", raw[4:8])[0], []
    size = {1: "B", 3: "H", 4: "I"}
    while at:
        (n,) = struct.unpack(order + "H", raw[at : at + 2])
        tags: dict[int, tuple] = {}
        for k in range(n):
            entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind in size:
                f = f"{order}{count}{size[kind]}"
                width = struct.calcsize(f)
                place = entry[8 : 8 + width] if width <= 4 else raw[(o := struct.unpack(order + "I", entry[8:12])[0]) : o + width]
                tags[tag] = struct.unpack(f, place)
        if (packing := tags.get(259, (1,))[0]) not in (1, 8, 32946):
            raise ValueError(f"TIFF compression {packing} is not supported")
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (16, 2): "i2"}[(tags[258][0], tags.get(339, (1,))[0])]
        data = b"".join(zlib.decompress(s) if packing != 1 else s for s in (raw[o : o + c] for o, c in zip(tags[273], tags[279], strict=True)))
        pages.append(np.frombuffer(data, order + kind, tags[257][0] * tags[256][0]).reshape(tags[257][0], tags[256][0]))
        at = struct.unpack(order + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return np.stack(pages)


def write_tiff(volume: np.ndarray) -> bytes:
    """The (pages, rows, columns) array as an uncompressed little-endian TIFF."""
    volume = np.ascontiguousarray(volume if volume.ndim == 3 else volume[None])
    bits, kind = volume.dtype.itemsize * 8, 3 if volume.dtype.kind == "f" else 2 if volume.dtype.kind == "i" else 1
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for k, page in enumerate(volume):
        data = page.astype(page.dtype.newbyteorder("<")).tobytes()
        at = len(out)
        tags = [(256, page.shape[1]), (257, page.shape[0]), (258, bits), (259, 1), (262, 1), (273, at + 2 + 12 * 9 + 4), (278, page.shape[0]), (279, len(data)), (339, kind)]
        after = at + 2 + 12 * 9 + 4 + len(data)
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", after if k + 1 < len(volume) else 0) + data
    return bytes(out)


def read_nrrd(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(array in file order, header) of an attached NRRD, raw or gzip."""
    head, _, data = raw.partition(b"\n\n")
    lines = head.decode("ascii", "replace").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = {k.strip().lower(): v.strip() for k, v in (re.split(r":=?", x, maxsplit=1) for x in lines[1:] if x and not x.startswith("#") and ":" in x)}
    if fields["type"] not in NRRD_TYPES:
        raise ValueError(f"NRRD type {fields['type']!r} is not supported")
    if fields.get("encoding") in ("gzip", "gz"):
        data = gzip.decompress(data)
    kind = np.dtype(("<" if fields.get("endian", "little") == "little" else ">") + NRRD_TYPES[fields["type"]])
    sizes = [int(x) for x in fields["sizes"].split()]
    return np.frombuffer(data, kind, int(np.prod(sizes))).reshape(sizes[::-1]), fields


def read_mhd_header(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, v in (x.split("=", 1) for x in text.splitlines() if "=" in x)}


def read_mha(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(array in file order, header) of a MetaImage with its pixels in the same file."""
    head, _, data = raw.partition(b"ElementDataFile = LOCAL\n")
    fields = read_mhd_header(head.decode("ascii", "replace"))
    if fields.get("CompressedData") == "True":
        data = zlib.decompress(data)
    sizes = [int(x) for x in fields["DimSize"].split()]
    kind = np.dtype((">" if fields.get("ElementByteOrderMSB") == "True" else "<") + MET_TYPES[fields["ElementType"]])
    return np.frombuffer(data, kind, int(np.prod(sizes))).reshape(sizes[::-1]), fields


def read_nifti(raw: bytes) -> tuple[np.ndarray, dict[str, object]]:
    """(array in file order, header) of a NIfTI-1 or Analyze image in one file."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    spacing = struct.unpack(order + "8f", raw[76:108])[1:4]
    at = int(struct.unpack(order + "f", raw[108:112])[0]) or 352
    sizes = dims[1 : dims[0] + 1]
    return np.frombuffer(raw, order + NIFTI_TYPES[code], int(np.prod(sizes)), at).reshape(sizes[::-1]), {"spacing": spacing, "sizes": sizes}


def write_nrrd(volume: np.ndarray, spacing: tuple[float, ...] | None = None, compress: bool = True) -> bytes:
    """An attached NRRD of an array in file order (last axis fastest); spacings go from the fastest axis on."""
    data = np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<")))
    names = {v: k for k, v in reversed(NRRD_TYPES.items())}
    lines = ["NRRD0004", f"type: {names[data.dtype.str[1:]]}", f"dimension: {data.ndim}", "sizes: " + " ".join(map(str, data.shape[::-1])), f"encoding: {'gzip' if compress else 'raw'}", "endian: little"]
    if spacing:
        lines.append("spacings: " + " ".join(map(repr, spacing)))
    raw = data.tobytes()
    return ("\n".join(lines) + "\n\n").encode() + (gzip.compress(raw, mtime=0) if compress else raw)


def write_mha(volume: np.ndarray, spacing: tuple[float, ...] | None = None, compress: bool = False) -> bytes:
    """A MetaImage with its pixels in the same file."""
    data = np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<")))
    names = {v: k for k, v in reversed(MET_TYPES.items())}
    raw = zlib.compress(data.tobytes()) if compress else data.tobytes()
    fields = {"ObjectType": "Image", "NDims": data.ndim, "BinaryData": "True", "ElementByteOrderMSB": "False", "CompressedData": str(compress)}
    fields |= {"CompressedDataSize": len(raw)} if compress else {}
    fields |= {"ElementSpacing": " ".join(map(repr, spacing or (1.0,) * data.ndim)), "DimSize": " ".join(map(str, data.shape[::-1])), "ElementType": names[data.dtype.str[1:]], "ElementDataFile": "LOCAL"}
    return "".join(f"{k} = {v}\n" for k, v in fields.items()).encode() + raw


def write_nifti(volume: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), compress: bool = False) -> bytes:
    """A NIfTI-1 image in one file."""
    data = np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<")))
    codes = {v: k for k, v in reversed(NIFTI_TYPES.items())}
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape[::-1], *[1] * (7 - data.ndim))
    struct.pack_into("<hh", head, 70, codes[data.dtype.str[1:]], data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, *[1.0] * (7 - len(spacing)))
    struct.pack_into("<f", head, 108, 352.0)
    head[344:348] = b"n+1\0"
    out = bytes(head) + data.tobytes()
    return gzip.compress(out, mtime=0) if compress else out


def decode(name: str, raw: bytes) -> np.ndarray:
    """(z, y, x) of any supported file."""
    low = name.lower()
    if low.endswith((".tif", ".tiff")):
        out = read_tiff(raw)
    elif low.endswith(".nrrd"):
        out = read_nrrd(raw)[0]
    elif low.endswith(".mha"):
        out = read_mha(raw)[0]
    elif low.endswith((".nii", ".nii.gz")):
        out = read_nifti(raw)[0]
    else:
        raise ValueError(f"unknown image format: {name}")
    return out if out.ndim == 3 else out[None]


def read_pixels(spark: SparkSession, folder: str, nonzero: bool = True) -> DataFrame:
    """file, z, y, x, value (from 1) of all images below a folder; zeros left out unless asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for k, page in enumerate(decode(path, raw.as_py()), 1):
                    y, x = np.nonzero(page) if nonzero else (i.ravel() for i in np.indices(page.shape))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(y), pa.string()), pa.array(np.full(len(y), k, np.int32)), pa.array((y + 1).astype(np.int32)), pa.array((x + 1).astype(np.int32)), pa.array(page[y, x].astype(np.float64))],
                        names=["file", "z", "y", "x", "value"],
                    )

    return files.mapInArrow(run, "file string, z int, y int, x int, value double")


def check_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, ok: whether each image can be decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    decode(path, raw.as_py())
                    ok.append(True)
                except (ValueError, KeyError, struct.error, zlib.error, OSError, IndexError):
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(ok, pa.bool_())], names=["file", "ok"])

    return files.mapInArrow(run, "file string, ok boolean")


def images_from(pixels: DataFrame, by: list[str]) -> DataFrame:
    """One row per slice: height, width and the row-major pixels, absent ones 0. A slice is one image, so it fits a task."""
    size = pixels.groupBy(*by).agg(F.max("y").alias("height"), F.max("x").alias("width"), F.collect_list(F.struct("y", "x", "value")).alias("_p"))
    spread = F.map_from_entries(F.transform("_p", lambda p: F.struct(((p["y"] - 1) * F.col("width") + p["x"]).alias("k"), p["value"].alias("v"))))
    cells = F.transform(F.sequence(F.lit(1), F.col("height") * F.col("width")), lambda k: F.coalesce(F.try_element_at(F.col("_m"), k), F.lit(0.0)))
    return size.withColumn("_m", spread).select(*by, "height", "width", cells.alias("pixels"))
