"""Pixel preparation for the scorers (P16-P20), as ``mapInArrow`` jobs.

Images are rows of Spark's image schema (``height, width, nChannels, mode,
data``; bytes BGR, row-major). Each job turns a batch of image rows into
NCHW float32 tensors with NumPy; Spark partitions the images, so the work
scales with the number of executors. Resizing is bilinear with half-pixel
centres (the usual ``INTER_LINEAR`` geometry); integer rounding inside other
resize implementations can differ by one intensity level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Classifier normalisation is per channel in the order the bytes are stored
# (B, G, R): (x - mean) * scale.
from gridweave.constants import (  # noqa: E402,F401
    CELL_INPUT,
    CLS_CROP,
    CLS_MEAN,
    CLS_RESIZE_SHORT,
    CLS_SCALE,
    LAYOUT_INPUT,
)
from pyspark.sql.pandas.types import to_arrow_schema

CV_8UC3 = 16  # mode of 8-bit, 3-channel images


TENSORS_AT_ONCE = 16  # 79 MB of detector tensors at 3 x 640 x 640


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def source_positions(length: int, resized: int, first: int = 0, count: int | None = None) -> np.ndarray:
    """Where on an axis of ``length`` pixels the pixels ``first, first + 1, ...`` of its resized form lie (half-pixel centres)."""
    at = first + np.arange(resized if count is None else count, dtype=np.float64)
    return np.clip((at + 0.5) * (length / resized) - 0.5, 0, length - 1)


ROWS_AT_ONCE = 128  # of one plane of a resampled image: a block stays in the processor's cache


def resampled(img: np.ndarray, xs: np.ndarray, ys: np.ndarray, swap_rb: bool = False, out: np.ndarray | None = None, finish=None) -> np.ndarray:
    """Bilinear samples at every (y, x) of two axes of source positions, float32 planes (CHW; separable: x, then y).

    The first and last channel are swapped on request (P19). ``finish(plane, block, out)`` leaves its form of each
    block of a plane's rows in ``out`` and may work on the block in place; ``out`` takes the planes where given.
    """
    x0 = np.floor(xs).astype(np.int64)
    y0 = np.floor(ys).astype(np.int64)
    x1 = np.minimum(x0 + 1, img.shape[1] - 1)
    fx = (xs - x0).astype(np.float32)
    fy = (ys - y0).astype(np.float32)[:, None]
    planes = np.moveaxis(img, 2, 0)
    src = np.ascontiguousarray(planes[::-1] if swap_rb else planes, dtype=np.float32)
    rows = src.take(x0, axis=2, mode="clip")
    step = src.take(x1, axis=2, mode="clip")
    step -= rows
    step *= fx
    rows += step
    down = np.zeros_like(rows)  # from each row to the next, nothing past the last
    np.subtract(rows[:, 1:], rows[:, :-1], out=down[:, :-1])
    if out is None:
        out = np.empty((len(rows), len(ys), len(xs)), np.float32)
    held = np.empty((3, min(ROWS_AT_ONCE, len(ys)), len(xs)), np.float32)  # one memory for all blocks
    for first in range(0, len(ys), ROWS_AT_ONCE):
        at = slice(first, first + ROWS_AT_ONCE)
        block, above, share = held[:, : len(y0[at])]
        share[:] = fy[at]  # spread over the rows once for all planes: a product by a column takes each row by itself
        for plane in range(len(rows)):
            down[plane].take(y0[at], axis=0, out=block, mode="clip")  # no position lies outside; other modes work on a copy
            block *= share
            rows[plane].take(y0[at], axis=0, out=above, mode="clip")
            block += above
            if finish is None:
                out[plane, at] = block
            else:
                finish(plane, block, out[plane, at])
    return out


def sample_bilinear(img: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """:func:`resampled` as rows of pixels (HWC)."""
    return np.moveaxis(resampled(img, xs, ys), 0, 2)


def classification_tensor(img: np.ndarray, swap_rb: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """P16 + P17: the middle 224 x 224 of the image at shorter edge 256 (half-even size), normalised, CHW.

    Only the pixels of that window are sampled.
    """
    grow = CLS_RESIZE_SHORT / min(img.shape[:2])

    def middle(length: int) -> np.ndarray:
        resized = round(length * grow)
        return source_positions(length, resized, (resized - CLS_CROP) // 2, CLS_CROP)

    mean, factor = (np.array(v, np.float32) for v in (CLS_MEAN, CLS_SCALE))

    def normalise(plane: int, block: np.ndarray, out: np.ndarray) -> None:
        block -= mean[plane]
        np.multiply(block, factor[plane], out=out)

    return resampled(img, middle(img.shape[1]), middle(img.shape[0]), swap_rb, out, normalise)


def detection_tensor(img: np.ndarray, size: int, swap_rb: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """Stretch to ``size x size``, divide by 255, CHW (no channel swap unless asked, P19)."""

    def unit(plane: int, block: np.ndarray, out: np.ndarray) -> None:
        np.divide(block, np.float32(255.0), out=out)

    return resampled(img, source_positions(img.shape[1], size), source_positions(img.shape[0], size), swap_rb, out, unit)


def batch_memory(images: int, size: int) -> np.ndarray:
    """Room for a batch of tensors. Fresh memory costs a page fault for every 4 kB, so a task writes its batches over one."""
    return np.empty((images, 3, size, size), np.float32)


def tensors_of(imgs: Sequence[np.ndarray], fn, size: int, memory: np.ndarray | None = None) -> np.ndarray:
    """``fn(img, out=...)`` of every image, written straight into one ``N x 3 x size x size`` batch (in ``memory`` where given)."""
    batch = (batch_memory(len(imgs), size) if memory is None else memory)[: len(imgs)]
    for img, out in zip(imgs, batch, strict=True):
        fn(img, out=out)
    return batch


def checked_images(images: DataFrame, keys: Sequence[str], height: str = "height", width: str = "width") -> DataFrame:
    """The columns a pixel job reads; an image that is not 8-bit with 3 channels fails the query."""
    good = F.col("nChannels") == 3
    if "mode" in images.columns:
        good = good & (F.col("mode") == 16)
    what = F.concat_ws(" ", F.lit("not an 8-bit image of 3 channels:"), *[F.col(k).cast("string") for k in keys])
    data = F.when(good, F.col("data")).otherwise(F.raise_error(what).cast("binary"))
    return images.select(*keys, F.col(height).alias("height"), F.col(width).alias("width"), "nChannels", data.alias("data"))


def pixel_arrays(batch) -> list[np.ndarray]:
    """The images of an Arrow batch of :func:`checked_images` as arrays."""
    height, width, channels, data = (batch.column(c).to_pylist() for c in ("height", "width", "nChannels", "data"))
    return [to_array(*row) for row in zip(height, width, channels, data, strict=True)]


def _tensor_job(images: DataFrame, key: str, fn, swap_rb: bool, summarize: bool = False) -> DataFrame:
    """Run ``fn`` on every image of each Arrow batch; the tensors leave the task as one flat
    ``list<float>`` column (values buffer + offsets), with no per-element conversion.

    With ``summarize`` only ``(n_values, checksum)`` per image leaves the task
    (for checks over many images, where shipping whole tensors would dominate).
    A task holds the tensors of ``TENSORS_AT_ONCE`` images at most, whatever
    the size of the Arrow batches that reach it.
    """
    own = images.schema[key]
    if summarize:
        out = StructType([own, StructField("n_values", IntegerType()), StructField("checksum", DoubleType())])
    else:
        out = StructType(
            [own, StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("tensor", ArrayType(FloatType()))]
        )

    def run(batches):
        import pyarrow as pa

        spare = None
        for b in batches:
            for first in range(0, b.num_rows, TENSORS_AT_ONCE):
                part = b.slice(first, TENSORS_AT_ONCE)
                imgs = pixel_arrays(part)
                if summarize:
                    found = []
                    for img in imgs:
                        spare = fn(img, swap_rb, spare)  # one tensor's memory for all
                        found.append((spare.size, round(float(spare.ravel().sum(dtype=np.float64)), 2)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key), pa.array([n for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.float64())],
                        names=out.names,
                    )
                    continue
                flat = [fn(img, swap_rb).ravel() for img in imgs]
                offsets = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                tensor = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat), pa.float32()))
                size = [part.column(c).cast(pa.int32()) for c in ("height", "width")]
                yield pa.RecordBatch.from_arrays([part.column(key), *size, tensor], names=out.names)

    return checked_images(images, [key]).mapInArrow(run, out)


def classification_tensors(
    images: DataFrame, key: str = "image_id", swap_rb: bool = False, summarize: bool = False
) -> DataFrame:
    """P17 over a DataFrame of images: ``(key, height, width, tensor ARRAY<FLOAT>)`` of 3 x 224 x 224."""
    return _tensor_job(images, key, classification_tensor, swap_rb, summarize)


def detection_tensors(
    images: DataFrame, size: int = CELL_INPUT, key: str = "image_id", swap_rb: bool = False, summarize: bool = False
) -> DataFrame:
    """P18 over a DataFrame of images: ``(key, height, width, tensor)`` of 3 x size x size."""
    return _tensor_job(images, key, lambda img, sw, out=None: detection_tensor(img, size, sw, out), swap_rb, summarize)


WINDOW = ("crop_top", "crop_bottom", "crop_left", "crop_right")
PAGES_BROADCAST = 200_000  # pages whose windows are sent to every task (about 100 bytes each)


def with_windows(pages: DataFrame, per_page: DataFrame, page_key: str) -> DataFrame:
    """Every page image with the windows of its page.

    Spark takes an image for 100 bytes and would send the images themselves to the driver, to
    broadcast them. The windows travel instead and the images stay where they are; windows of more
    than ``PAGES_BROADCAST`` pages meet the images in a shuffled join that holds only windows in memory.
    The pages are counted for that, so ``per_page`` is best derived from stored windows.
    """
    few = per_page.select(page_key).limit(PAGES_BROADCAST + 1).count() <= PAGES_BROADCAST
    return pages.join(per_page.hint("broadcast" if few else "shuffle_hash"), page_key)


def cut(page: np.ndarray, window: dict, rgb_to_bgr: bool) -> np.ndarray:
    """The pixels of a window of a page (a view), channels reversed on request."""
    top, bottom, left, right = (max(int(window[e]), 0) for e in WINDOW)
    part = page[top:bottom, left:right]
    return part[:, :, ::-1] if rgb_to_bgr else part


def crop_pixels(
    page_images: DataFrame,
    windows: DataFrame,
    keys: Sequence[str] = ("page_id", "cluster_id"),
    page_key: str = "page_id",
    rgb_to_bgr: bool = True,
) -> DataFrame:
    """P19 + P20: cut each cluster's window out of its page image.

    ``page_images`` holds one rendered page per ``page_key``; ``windows`` the
    P14 columns ``crop_top, crop_bottom, crop_left, crop_right``. Windows are
    grouped per page first (a page has at most the layout model's detection
    slots), so each page image is joined once, not copied per window; the
    task slices every window out of it with NumPy. A window beyond the page is cut to it (no
    pixels: no bytes); a page that is not 8-bit with 3 channels fails the query.
    """
    keys = list(keys)
    own = [windows.schema[k] for k in keys]
    sizes = [StructField(c, IntegerType()) for c in ("height", "width", "nChannels", "mode")]
    schema = StructType(own + sizes + [StructField("data", BinaryType())])
    per_page = windows.groupBy(page_key).agg(F.collect_list(F.struct(*[k for k in keys if k != page_key], *WINDOW)).alias("_w"))
    pages = with_windows(checked_images(page_images, [page_key]), per_page, page_key)
    types = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                page, page_id = pixel_arrays(row)[0], row.column(page_key)
                for window in row.column("_w")[0].as_py():  # a crop at a time: together they may exceed their page
                    part = cut(page, window, rgb_to_bgr)
                    values = [window.get(k) for k in keys] + [*part.shape, CV_8UC3, part.tobytes()]
                    columns = [page_id if f.name == page_key else pa.array([v], f.type) for f, v in zip(types, values, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=types.names)

    return pages.mapInArrow(run, schema)


def derived_images(source: DataFrame, key: str = "image_id") -> DataFrame:
    """Small BGR images computed from a key column (image schema, 8-bit 3-channel).

    ``width = 32 + key % 24``, ``height = 24 + key % 16``; byte ``i`` of image
    ``k`` is ``(7 i + 13 k) mod 256``. Bytes are generated with NumPy per
    Arrow batch inside the tasks, so the frame grows with its source table.
    """
    schema = StructType(
        [
            StructField(key, LongType()),
            StructField("origin", StringType()),
            StructField("height", IntegerType()),
            StructField("width", IntegerType()),
            StructField("nChannels", IntegerType()),
            StructField("mode", IntegerType()),
            StructField("data", BinaryType()),
        ]
    )

    def run(batches):
        import pyarrow as pa

        steps = (np.arange(55 * 39 * 3) * 7 % 256).astype(np.uint8)  # of the largest image; sums of bytes are taken mod 256
        for b in batches:
            ks = b.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            ws = (32 + ks % 24).astype(np.int32)
            hs = (24 + ks % 16).astype(np.int32)
            data = [(steps[: h * w * 3] + first).tobytes() for first, h, w in zip((ks * 13 % 256).astype(np.uint8), hs, ws)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks), pa.array([f"derived:{k}" for k in ks]), pa.array(hs), pa.array(ws),
                 pa.array(np.full(len(ks), 3, np.int32)), pa.array(np.full(len(ks), 16, np.int32)),
                 pa.array(data, type=pa.binary())],
                names=[f.name for f in schema.fields],
            )

    # The key-only input is tiny in bytes but each row costs real CPU here and
    # downstream; spread it over the cluster's cores explicitly (AQE does not
    # coalesce an explicit repartition).
    n = source.sparkSession.sparkContext.defaultParallelism
    keys = source.select(F.col(key).cast("bigint").alias(key)).repartition(n, key)
    return keys.mapInArrow(run, schema)
