"""detectors read their pixels once and decide as the plain means do; planes are finished one by one."""

import numpy as np

from gridweave.operators import pixels as PX
from gridweave.sources import derived as D


def plain(image, columns, invert):
    """Row count and scores from the mean of every cell's pixels."""
    s = image.shape[1]
    k = 3 + int(image.mean() * 1000) % 6
    cells = [image[:, int(r * s / k) : int((r + 1) * s / k), int(c * s / columns) : int((c + 1) * s / columns)] for r in range(k) for c in range(columns)]
    means = [float(cell.mean()) for cell in cells]
    return k, np.array([1.0 - m if invert else m for m in means], np.float32)


def pictures():
    rng = np.random.default_rng(11)
    out = [np.resize((np.arange(600) * step + first).astype(np.uint8), (24, 32, 3)) for step, first in ((7, 13), (1, 0), (128, 3), (85, 0))]
    out += [rng.integers(0, 256, (int(h), int(w), 3), dtype=np.uint8) for h, w in rng.integers(1, 60, (8, 2))]
    return out + [np.full((5, 4, 3), v, np.uint8) for v in (0, 51, 102, 255)] + [np.resize(np.uint8([0, 255]), (30, 40, 3))]  # means by the edges


def test_a_grid_decides_as_the_means_of_its_pixels():
    for size in (64, 200):
        x = PX.tensors_of(pictures(), lambda img, out: PX.detection_tensor(img, size, out=out), size)
        for columns, invert in ((3, False), (4, True)):
            rows, counts = D.grid_detector(columns, invert)()(x)
            for image, got in zip(x, np.split(rows, np.cumsum(counts)[:-1]), strict=True):
                k, scores = plain(image, columns, invert)
                assert len(got) == k * columns and np.abs(got[:, 1] - scores).max() < 1e-5
                assert np.array_equal(got[:, 1] > 0.5, scores > 0.5) and np.array_equal(got[:, 1] > 0, scores > 0)
                assert got[-1, 2:].tolist() == [np.float32((columns - 1) * size / columns), np.float32((k - 1) * size / k), size, size]


class Counted(np.ndarray):
    """Pixels that count the means taken of them."""

    taken = 0

    def mean(self, *args, **kwargs):
        Counted.taken += 1
        return np.asarray(self).mean(*args, **kwargs)


def test_a_detector_does_not_read_the_pixels_again_for_every_cell():
    x = PX.tensors_of([np.full((9, 7, 3), v, np.uint8) for v in (30, 70, 200)], lambda img, out: PX.detection_tensor(img, 64, out=out), 64)
    Counted.taken = 0
    _, counts = D.grid_detector(3)()(x.view(Counted))
    assert counts.sum() >= 27 and Counted.taken == 0


def test_planes_are_finished_one_by_one():
    img = np.random.default_rng(2).integers(0, 256, (40, 33, 3), dtype=np.uint8)
    seen = []

    def finish(plane, block, out):
        seen.append((plane, block.shape, block.flags.c_contiguous))
        out[:] = block

    rows, cols = 3 * PX.ROWS_AT_ONCE // 2, 50
    got = PX.resampled(img, PX.source_positions(33, cols), PX.source_positions(40, rows), finish=finish)
    halves = (PX.ROWS_AT_ONCE, PX.ROWS_AT_ONCE // 2)
    assert seen == [(plane, (n, cols), True) for n in halves for plane in range(3)]
    assert np.array_equal(got, PX.resampled(img, PX.source_positions(33, cols), PX.source_positions(40, rows)))
