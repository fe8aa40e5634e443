"""Poses of a batch of views end with their own error, not with the batch's slowest view."""

import numpy as np

from markerflow.operators import calibration as cal


def test_views_that_are_done_take_no_part():
    lens = np.array([900.0, 905.0, 640.0, 360.0, -0.05, 0.01, 0.001, -0.0005, 0.002])
    board = np.array([[i * 0.1 - 0.35, j * 0.1 - 0.2] for i in range(8) for j in range(5)])
    rng = np.random.default_rng(5)
    r, t = cal.turn(rng.uniform(-0.4, 0.4, (50, 3))), np.column_stack([rng.uniform(-0.1, 0.1, (50, 2)), rng.uniform(1, 1.5, 50)])
    pixels = cal.seen(np.einsum("vij,pj->vpi", r[:, :, :2], board) + t[:, None], lens)[0]
    data, weight = np.concatenate([np.broadcast_to(board, pixels.shape), pixels], -1), np.ones(pixels.shape[:2])
    seen = []

    def counted(shared, part, *pose):
        seen.append(len(part))
        return cal.mono_residuals(shared, part, *pose)

    wrong = lens * [1.01, 0.99, 1, 1, 0.5, 1, 1, 1, 1]
    for shared, exact in ((lens, True), (wrong, False)):
        seen.clear()
        found_r, found_t = cal.best_poses(counted, shared, data, weight, *cal.start_poses(shared, data, weight))
        assert sum(seen) <= 10 * len(data) and min(seen) < len(data)
        if exact:
            assert np.abs(found_r - r).max() < 1e-9 and np.abs(found_t - t).max() < 1e-9
        # no direction leads to less error
        e, _, j = cal.mono_residuals(shared, data, found_r, found_t)
        slope, most = np.einsum("vpri,vpr->vi", j, e), np.einsum("vpri,vpr->vi", np.abs(j), np.abs(e))
        assert (np.abs(slope) <= 1e-5 * most + 1e-6).all()
