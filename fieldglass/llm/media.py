"""Copies among images by local descriptors.

A media column holds grey images as binary PGM (P5) or colour ones as PPM (P6),
8 bits a channel. Each image gives corners at three scales (Harris measure,
strongest in their surroundings); each corner gets an orientation from the
intensity centroid and a binary descriptor of brightness comparisons in a patch
turned by it. Descriptors are cut into chunks, one Hamming table per chunk: equal
chunks bring two images together. Such pairs are verified by geometry: matched
corners must agree on one similarity transform (scale, turn and shift), as they
do for a crop or an edited copy. Links make classes (``linking``).

Comparisons of brightness do not change with brightness or contrast, descriptors
are local, so crops and overlays keep most of them.

Equal bytes are one item. Null, empty or unreadable media, and images without
corners, are grouped by equality of their bytes only (null and empty are equal).
Repeated rows and null ids stay. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.linking import link, shared_buckets
from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage
from fieldglass.llm.words import U64, mix

#: Steps of the image pyramid and corners taken from each.
SCALES = ((1.0, 24), (0.7, 10), (0.5, 6))
RADIUS = 20
MARGIN = RADIUS + 2
#: Hamming tables and the bits of each.
TABLES, TABLE_BITS = 4, 64
BITS = TABLES * TABLE_BITS
#: Differing bits up to which corners match; agreeing corners that make a copy.
MOST_BITS = 36
LEAST_CORNERS = 5
#: Share of the poorer image's corners that must agree.
LEAST_SHARE = 0.25
#: Pixels, turn (radians) and scale by which agreeing corners may miss.
MISS_PIXELS, MISS_TURN, MISS_SCALE = 4.0, 0.35, 1.25
#: Pixels of images handled at once.
BATCH_PIXELS = 1 << 20


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey image in a binary PGM or PPM, or None."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    try:
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        width, height, most = fields
        channels = 1 if data[:2] == b"P5" else 3
        if most != 255:
            return None
        pixels = np.frombuffer(data, np.uint8, width * height * channels, at + 1).astype(np.float32)
    except ValueError:
        return None
    if channels == 3:
        return pixels.reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114], dtype=np.float32)
    return pixels.reshape(height, width)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r+1 of a stack of images."""
    n = 2 * r + 1
    padded = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge")
    sums = padded.cumsum(axis=1, dtype=np.float64).cumsum(axis=2)
    return ((sums[:, n:, n:] - sums[:, :-n, n:] - sums[:, n:, :-n] + sums[:, :-n, :-n]) / (n * n)).astype(np.float32)


def _shrunk(x: np.ndarray, scale: float) -> np.ndarray:
    """A stack of images at a smaller size, each pixel from the nearest smoothed one."""
    if scale == 1.0:
        return x
    h, w = int(x.shape[1] * scale), int(x.shape[2] * scale)
    rows = np.minimum(((np.arange(h) + 0.5) / scale).astype(int), x.shape[1] - 1)
    cols = np.minimum(((np.arange(w) + 0.5) / scale).astype(int), x.shape[2] - 1)
    return _box(x, 1)[:, rows][:, :, cols]


def _corners(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image numbers, rows and columns of the strongest corners of each image."""
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[:, 1:-1] = x[:, 2:] - x[:, :-2]
    gx[:, :, 1:-1] = x[:, :, 2:] - x[:, :, :-2]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    measure = a * b - c * c - 0.05 * (a + b) ** 2
    top = measure
    for axis in (1, 2):
        wide = top
        for d in (1, 2, 3):
            for s in (d, -d):
                wide = np.maximum(wide, np.roll(top, s, axis=axis))
        top = wide
    inner = np.zeros(x.shape, dtype=bool)
    inner[:, MARGIN:-MARGIN, MARGIN:-MARGIN] = True
    n, r, k = np.nonzero(inner & (measure == top) & (measure > 1e3))
    order = np.lexsort((k, r, -measure[n, r, k], n))
    n, r, k = n[order], r[order], k[order]
    rank = np.arange(len(n)) - np.searchsorted(n, n)
    kept = rank < most
    return n[kept], r[kept], k[kept]


def _tests() -> np.ndarray:
    """Pairs of points in a disc, drawn once from a fixed seed: (bits, 4)."""
    draw = np.random.default_rng(5)
    out = draw.normal(0, RADIUS / 2, (BITS * 4, 4))
    good = (np.hypot(out[:, 0], out[:, 1]) < RADIUS) & (np.hypot(out[:, 2], out[:, 3]) < RADIUS)
    return out[good][:BITS]


_DISC = [(dy, dx) for dy in range(-15, 16) for dx in range(-15, 16) if dy * dy + dx * dx <= 225]


def describe(images: list[np.ndarray]) -> list[np.ndarray]:
    """Corners of images of one shape: rows of x, y, scale, turn and descriptor bytes."""
    stack = np.stack(images)
    found: list[list[np.ndarray]] = [[] for _ in images]
    tests = _tests()
    dy, dx = (np.array(v) for v in zip(*_DISC, strict=True))
    for scale, most in SCALES:
        if min(stack.shape[1:]) * scale <= 2 * MARGIN + 1:
            continue
        x = _shrunk(stack, scale)
        n, r, k = _corners(x, most)
        if not len(n):
            continue
        smooth = _box(x, 2)
        disc = smooth[n[:, None], r[:, None] + dy, k[:, None] + dx]
        turn = np.arctan2((disc * dy).sum(axis=1), (disc * dx).sum(axis=1))
        cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]

        def at(u, v, cos=cos, sin=sin, n=n, r=r, k=k, smooth=smooth):
            rows = np.rint(r[:, None] + sin * u + cos * v).astype(int)
            cols = np.rint(k[:, None] + cos * u - sin * v).astype(int)
            return smooth[n[:, None], rows, cols]

        # A small step keeps flat places from flickering.
        bits = at(tests[:, 0], tests[:, 1]) > at(tests[:, 2], tests[:, 3]) + 1.0
        packed = np.packbits(bits, axis=1)
        for i in range(len(n)):
            found[n[i]].append((k[i] / scale, r[i] / scale, scale, turn[i], packed[i]))
    return [_records(f) for f in found]


_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("turn", "<f4"), ("bits", "u1", BITS // 8)])


def _records(rows: list) -> np.ndarray:
    return np.array(rows, dtype=_RECORD)


def table_keys(corners: np.ndarray) -> list[int]:
    """The distinct keys of an image in all Hamming tables."""
    if not len(corners):
        return []
    parts = np.zeros((len(corners), TABLES, 8), dtype=np.uint8)
    parts[:, :, : TABLE_BITS // 8] = corners["bits"].reshape(len(corners), TABLES, TABLE_BITS // 8)
    keys = mix(parts.view(U64)[:, :, 0] * U64(TABLES + 1) + np.arange(TABLES, dtype=U64)[None, :])
    return np.unique(keys).view(np.int64).tolist()


def same_scene(x: bytes, y: bytes) -> bool:
    """Whether corners of two images agree on one similarity transform."""
    a, b = np.frombuffer(x, _RECORD), np.frombuffer(y, _RECORD)
    apart = np.bitwise_count(a["bits"][:, None, :] ^ b["bits"][None, :, :]).sum(axis=2)
    near = apart.argmin(axis=1)
    i = np.flatnonzero(apart[np.arange(len(a)), near] <= MOST_BITS)
    j = near[i]
    # A corner of the second image answers its best match only.
    back = apart.argmin(axis=0)[j] == i
    i, j = i[back], j[back]
    need = max(LEAST_CORNERS, int(np.ceil(LEAST_SHARE * min(len(a), len(b)))))
    if len(i) < need:
        return False
    p, q = a[i], b[j]
    ratio = p["scale"] / q["scale"]
    turn = q["turn"] - p["turn"]
    # Each match proposes a transform; the others vote by where it puts them.
    cos, sin = ratio * np.cos(turn), ratio * np.sin(turn)
    dx, dy = p["x"][None, :] - p["x"][:, None], p["y"][None, :] - p["y"][:, None]
    to_x = q["x"][:, None] + cos[:, None] * dx - sin[:, None] * dy
    to_y = q["y"][:, None] + sin[:, None] * dx + cos[:, None] * dy
    close = np.hypot(to_x - q["x"][None, :], to_y - q["y"][None, :]) <= MISS_PIXELS
    turned = np.abs(np.angle(np.exp(1j * (turn[:, None] - turn[None, :])))) <= MISS_TURN
    grown = np.abs(np.log(ratio[:, None] / ratio[None, :])) <= np.log(MISS_SCALE)
    return int((close & turned & grown).sum(axis=1).max()) >= need


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        by_shape: dict[tuple, list[tuple[int, np.ndarray]]] = {}

        def done(held: list[tuple[int, np.ndarray]], items=batch["item"]) -> pd.DataFrame:
            corners = describe([image for _, image in held])
            return pd.DataFrame(
                {
                    "item": [items.iloc[i] for i, _ in held],
                    "bands": [table_keys(c) for c in corners],
                    "grams": [c.tobytes() for c in corners],
                }
            )

        for i, data in enumerate(batch["media"]):
            image = decode(data)
            if image is None or min(image.shape) <= 2 * MARGIN + 1:
                continue
            held = by_shape.setdefault(image.shape, [])
            held.append((i, image))
            if len(held) * image.size >= BATCH_PIXELS:
                yield done(by_shape.pop(image.shape))
        for held in by_shape.values():
            yield done(held)


def image_classes(media: DataFrame) -> DataFrame:
    """``media_id, class_id, class_size, corners`` for every row of ``media_id, media``.

    A class is named by the smallest id in it.
    """
    content = F.coalesce("media", F.lit(b""))
    given = media.select(F.col("media_id").cast("long").alias("media_id"), content.alias("media"), F.xxhash64(content).alias("item"))
    found = stage(
        given.select("item", "media")
        .dropDuplicates(["item"])
        .mapInPandas(_described, "item long, bands array<long>, grams binary"),
        "corners",
    )
    groups = link(shared_buckets(found.select("item", "bands")), found.select("item", "grams"), same_scene, nearest_first=True)
    counted = found.select("item", (F.octet_length("grams") / _RECORD.itemsize).cast("int").alias("corners"))
    rows = stage(
        given.select("media_id", "item")
        .join(groups, "item", "left")
        .join(counted, "item", "left")
        .select("media_id", F.coalesce("group", "item").alias("group"), F.coalesce("corners", F.lit(0)).alias("corners")),
        "media-rows",
    )
    named = rows.groupBy("group").agg(F.min("media_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "group").select("media_id", "class_id", "class_size", "corners")


#: Squares along a side of a drawn picture and pixels along a side of a square.
SQUARES, CELL = 16, 10


def _picture(vector) -> np.ndarray:
    """A grey image of a vector: a grid of squares, each the sum of two of its numbers, darkest to brightest."""
    v = np.asarray(vector, dtype=float)
    v = np.nan_to_num(v) if len(v) else np.zeros(1)
    i = np.arange(SQUARES * SQUARES)
    cells = v[i % len(v)] + v[(i * i // 3 + 5 * i + 7) % len(v)]
    low, high = cells.min(), cells.max()
    grey = np.rint((cells - low) / max(high - low, 1e-12) * 215 + 20).astype(np.uint8)
    return np.kron(grey.reshape(SQUARES, SQUARES), np.ones((CELL, CELL), dtype=np.uint8))


def encode(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A crop with changed brightness and contrast and a plain square laid over it."""
    draw = np.random.default_rng(seed)
    h, w = image.shape
    top, left = draw.integers(0, h // 8, 2)
    cut = image[top : h - draw.integers(0, h // 8), left : w - draw.integers(0, w // 8)].astype(float)
    cut = np.clip(cut * draw.uniform(0.75, 0.95) + draw.uniform(0, 10), 0, 255)
    y, x = draw.integers(0, cut.shape[0] - 24), draw.integers(0, cut.shape[1] - 24)
    cut[y : y + 24, x : x + 24] = 255
    return np.rint(cut)


#: Every so many images get an edited copy in the derived table.
COPY_EVERY = 10


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            ids, media = [], []
            part = batch.iloc[start : start + 256]
            for key, vector in zip(part["vec_id"], part["embedding"], strict=True):
                image = _picture(vector if vector is not None else [])
                ids.append(int(key))
                media.append(encode(image))
                if key % COPY_EVERY == 0:
                    ids.append(-int(key) - 1)
                    media.append(encode(edited(image, int(key))))
            yield pd.DataFrame({"media_id": ids, "media": media})


def pictures(vectors: DataFrame) -> DataFrame:
    """A media table drawn from ``vec_id, embedding``: one image per vector and, for every tenth id, an edited copy.

    The copy of ``id`` has the id ``-id - 1``.
    """
    return vectors.select("vec_id", "embedding").where("vec_id is not null").mapInPandas(
        _drawn, "media_id long, media binary"
    )


@query("op3_image_copies")
def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of copies of every image drawn from the embeddings."""
    return image_classes(pictures(table(spark, sf_dir, "embeddings")))
