"""Known cases of the pixel kernels on synthetic images."""

import numpy as np
import pytest

from reelscribe.operators import pixels


def texture(width, height, top=0):
    y, x = np.mgrid[top : top + height, 0:width]
    v = (128 + 60 * np.sin(x * 0.05 + y * 0.031) + 60 * np.sin(y * 0.017 + 0.00007 * y * y)).astype(np.uint8)
    return np.dstack([v, v, v, np.full_like(v, 255)])


def frames(spark, images):
    rows = [(1, i, x.tobytes(), x.shape[1], x.shape[0]) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, "recording_id long, frame_idx int, data binary, width int, height int")


@pytest.mark.parametrize("dy", [13, 40, 100])
def test_shifts(dy):
    old, new = (pixels.grey(texture(64, 480, t)) for t in (0, dy))
    assert pixels.full_shift(old, new) == (dy, 1.0)
    assert abs(pixels.coarse_shift(old[::4, ::4], new[::4, ::4])[0] - dy) <= 4


def test_crop_comes_before_subsampling(spark):
    image = texture(67, 407)
    got = pixels.coarse_images(frames(spark, [image]), 3, 406).first().coarse
    assert (got.width, got.height) == (16, 100)
    assert bytes(got.data) == pixels.grey(image[3:403:4, :64:4]).tobytes()


def test_adjacent_shifts_and_key_frames(spark):
    images = [texture(64, 480, t) for t in (0, 40, 40, 120)]
    got = pixels.adjacent_shifts(pixels.coarse_images(frames(spark, images), 0, 480)).orderBy("pair_idx").collect()
    assert [(r.dy, r.conf) for r in got] == [(40, 1.0), (0, 1.0), (80, 1.0)]
    assert pixels.key_frames_of([40, -5, 30, 30, -3], 100) == ([0, 1, 4], 2, 0)
    steps = spark.createDataFrame([(1, i + 1, dy) for i, dy in enumerate([40, -5, 30, 30, -3])], "recording_id long, pair_idx int, dy int")
    r = pixels.key_frames(steps, 100).first()
    assert (r.keep, r.dropped, r.too_far) == ([0, 1, 4], 2, 0)


def test_stitching(spark):
    images = [texture(64, 480, t) for t in (0, 100, 80, 200)]
    r = pixels.stitched(frames(spark, images)).first()
    assert (list(r.offsets), r.height, r.skipped, list(r.unsure)) == ([0, 100, 200], 680, 1, [])
    assert bytes(r.data) == texture(64, 680).tobytes()
    black, white = np.zeros((400, 8, 4), np.uint8), np.full((400, 8, 4), 255, np.uint8)
    r = pixels.stitched(frames(spark, [black, white])).first()
    assert (list(r.offsets), r.height, list(r.unsure), r.skipped) == ([0, 380], 780, [1], 0)
    r = pixels.stitched(frames(spark, [black, black])).first()
    assert (r.skipped, list(r.unsure)) == (1, [])


def test_scroll_region(spark):
    still = np.zeros((10, 100, 16), np.uint8)
    assert pixels.scroll_region(still) == {"top": 0, "bottom": 100, "threshold": 10.0, "ok": False}
    rng = np.random.default_rng(1)
    moving = still.copy()
    moving[:, 20:90] = rng.integers(0, 255, (10, 70, 16))
    found = pixels.scroll_region(moving)
    assert (found["top"], found["bottom"], found["ok"]) == (20, 90, True)
    moving[:, 40:60] = 7  # a quiet stretch inside
    assert pixels.scroll_region(moving)["top"] == 20


def test_bitmap(spark):
    image = np.array([[[1, 2, 3, 255], [4, 5, 6, 255]], [[7, 8, 9, 255], [10, 11, 12, 255]]], np.uint8)
    (r,) = pixels.bitmaps(frames(spark, [image])).collect()
    assert len(r.bmp) == 70 and bytes(r.bmp[:2]) == b"BM" and list(r.bmp[54:62]) == [9, 8, 7, 12, 11, 10, 0, 0] and list(r.bmp[62:68]) == [3, 2, 1, 6, 5, 4]


def test_samples(spark):
    image = np.full((20, 20, 4), 10, np.uint8)
    image[:10] = (100, 200, 120, 255)
    requests = [("a", 0, 0, 10, 10), ("b", 0, 0, 20, 20), ("c", 30, 0, 5, 5), ("d", 0, 0, 0, 5), ("e", 0, 10, 10, 10)]
    df = spark.createDataFrame([(1, i, 0, x, y, w, h) for i, x, y, w, h in requests], "recording_id long, id string, frame_idx int, x int, y int, width int, height int")
    got = {r.id: r for r in pixels.region_samples(df, frames(spark, [image])).collect()}
    assert (got["a"].side, list(got["a"].rgb), got["a"].decoded_pixels) == ("me", [100, 200, 120], 100)
    assert [got[i].error for i in "bcd"] == ["E_FULL_FRAME_FORBIDDEN", "E_RECT", "E_RECT"]
    assert got["e"].side is None and got["e"].error is None
    assert pixels.bright_median(np.full((2, 2, 4), 150, np.uint8)) == ([150, 150, 150], 0)
    assert pixels.bright_median(np.zeros((0, 0, 4), np.uint8)) == (None, 0)


def test_segment_lines(spark):
    image = np.full((40, 40, 4), 250, np.uint8)
    lines = spark.createDataFrame([(1, 0, "t", 2.0, 3.0, 10.0, 10.0, 2.0), (1, 1, "out", 90.0, 3.0, 5.0, 5.0, 0.0)], "recording_id long, line_no int, text string, x double, y double, w double, h double, segment_top double")
    got = pixels.segment_lines(lines, frames(spark, [image]).drop("frame_idx")).orderBy("line_no").collect()
    assert (got[0].y, list(got[0].rgb), got[1].rgb) == (5.0, [250, 250, 250], None)


def rule_of_key_frames(steps, view):
    """The rule frame by frame, on sets."""
    bounced = {i + 1 for i, dy in enumerate(steps) if dy < 0}
    at = {0: 0}
    for i, dy in enumerate(steps):
        at[i + 1] = at[i] + max(0, dy)
    fine = [k for k in at if k not in bounced]
    keep = [0]
    for k in list(at)[1:]:
        if at[k] - at[keep[-1]] > view * 0.6:
            before, upto = (max(f for f in fine if f <= n) for n in (k - 1, k))
            keep += [f for f in (before, upto) if f > keep[-1]][:1]
    keep += [fine[-1]] if fine[-1] > keep[-1] else []
    return keep, len(bounced), sum(at[b] - at[a] >= view for a, b in zip(keep, keep[1:]))


def test_key_frames_follow_the_rule():
    rng = np.random.default_rng(8)
    for _ in range(400):
        steps = rng.choice([-9, 0, 10, 25, 61, 130], rng.integers(0, 14)).tolist()
        got, wanted = pixels.key_frames_of(steps, 100), rule_of_key_frames(steps, 100)
        assert (got[0], got[1]) == wanted[:2], steps


def test_ppm_and_bad_frames(spark):
    data = b"P6 # made by hand\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])
    r = pixels.ppm_images(spark.createDataFrame([("a.ppm", bytearray(data))], "path string, content binary")).first()
    assert (bytes(r.data), r.width, r.height) == (bytes([1, 2, 3, 255, 4, 5, 6, 255]), 2, 1)
    bad = spark.createDataFrame([(1, 0, bytearray(b"xyz"), 2, 2), (1, 1, bytearray(b"x" * 12), 2, 2), (1, 2, None, 2, 2)], "recording_id long, frame_idx int, data binary, width int, height int")
    asked = spark.createDataFrame([(1, str(f), f, 0, 0, 1, 1) for f in range(4)], "recording_id long, id string, frame_idx int, x int, y int, width int, height int")
    got = {r.id: r.error for r in pixels.region_samples(asked, bad).collect()}
    assert got == {"0": "E_DECODE", "1": "E_CONFIG", "2": "E_DECODE", "3": "E_FRAME"}


def test_the_stitch_plan_marks_what_it_cannot_stitch(spark):
    from reelscribe.plans import scroll
    from reelscribe.plans.stitch import StitchPlan

    def frames(recording, positions):
        return [(recording, i, *scroll.screen_pixels(recording, p)) for i, p in enumerate(positions)]

    rows = frames(1, [400, 640, 880, 880, 1360]) + frames(2, [400]) + frames(3, [400, 640, 880]) + frames(4, [400, 640, 880]) + frames(5, [400, 640, 4000, 4200])
    rows[6] = (3, 0, b"\0" * 32, 2, 4)
    del rows[-7]
    plan = StitchPlan(spark.createDataFrame(rows, "recording_id int, frame_idx int, data binary, width int, height int"))
    placed = plan.placed
    got = {r.recording_id: r for r in plan.summary(placed).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "no_region", 3: "mixed_sizes", 4: "gaps", 5: "ok"}
    assert got[1].height == got[1].bottom - got[1].top + 960 and got[5].n_unsure == 1 and got[4].n_key is None
    bands = plan.bands(placed).where("recording_id = 1").orderBy("offset").collect()
    image = np.concatenate([np.frombuffer(bytes(b.data), np.uint8).reshape(b.rows, b.width, 4) for b in bands])
    page = scroll.screen_page(1, got[1].top + 400 + np.arange(len(image)))
    assert len(image) == got[1].height and (image[..., 0] == page % 256).all()
