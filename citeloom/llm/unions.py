"""Union of pairs within one task, in numpy."""

from __future__ import annotations

import numpy as np


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label after joining each i with its j.

    label, before and after, is fully compressed: every member points at the
    smallest member of its component. Only roots are hooked, and a pair stays
    open until both its ends have one root, so no join is lost whatever the
    order of the calls.
    """
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = a[apart], b[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label != (further := label[label])).any():
            label = further
