"""Text grids as rasters: drawn, compared and handed on in parts."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from revdelta.operators import alignment, rasters
from revdelta.plans import visual


def test_grids_are_drawn_where_they_are_compared(spark):
    pages = spark.createDataFrame(
        [("d", "earlier", 1, "ab c\n\nxyz"), ("d", "newer", 1, "ab d\nq"), ("d", "newer", 2, "lone é😀")],
        "pair_id string, side string, page_number int, text string",
    )
    pairs = visual.raster_pairs(pages, alignment.by_position(alignment.fingerprints(pages)))
    assert dict(pairs.dtypes)["earlier"] == "string"  # rasters are never rows
    texts = {r.idx: r for r in pairs.collect()}
    assert [(r.width, r.height) for _, r in sorted(texts.items())] == [(4, 3), (7, 1)]
    drawn = [(r.idx, r.width, r.height, *[rasters.grid(t, r.width, r.height).tobytes() for t in (r.earlier, r.newer)]) for r in texts.values()]
    images = spark.createDataFrame(drawn, "idx int, width int, height int, earlier binary, newer binary")
    told = lambda p: sorted(rasters.compare(p.select(*images.columns), 0.1, overlays=True).collect())
    assert told(pairs) == told(images)
    sums = {r.idx: r for r in rasters.layer_sums(pairs.withColumn("dx", F.col("idx") - 1), 0.1, True).collect()}
    for dx, idx in ((0, 1), (1, 2)):
        whole = rasters.layered(images.where(F.col("idx") == idx), 0.1, True, dx=dx).first()
        of = lambda name, depth, k: int(np.frombuffer(whole[name], np.uint8)[k::depth].sum(dtype=np.int64))
        assert sums[idx].base_pixels == of("base", 4, 3) // 255 and sums[idx].base_grey == of("base", 4, 0)
        assert [sums[idx][f"{n}_alpha"] for n in ("added", "removed", "modified")] == [of(n, 4, 3) for n in ("added", "removed", "modified")]
        assert [sums[idx][c] for c in ("red", "green", "blue")] == [of("composed", 3, k) for k in range(3)]


def test_results_leave_a_task_in_parts():
    rows = pd.DataFrame({"idx": range(200), "earlier": "", "newer": ""})
    parts = list(rasters._each(lambda row: (row.idx,), ["n"], rasters.PART)([rows]))
    assert max(map(len, parts)) <= rasters.PART and [n for p in parts for n in p["n"]] == list(range(200))


def test_pictures_are_packed_band_by_band():
    img = np.random.default_rng(3).integers(0, 9, (900, 700, 4), np.uint8)
    assert len(rasters._bands(img)) > 2
    rows = np.concatenate([np.zeros((900, 1), np.uint8), img.reshape(900, -1)], axis=1).tobytes()
    data = rasters.png(img)
    assert zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]) == rows
