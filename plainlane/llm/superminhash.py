"""SuperMinHash signatures of many sets at once.

Every element walks through the slots in an order of its own, a random permutation that is drawn step by step, and in
step j offers its j-th uniform number plus j to the slot of that step. Ranks of one element in different slots are thus
correlated (no slot gets two of its small values), which lowers the variance against independent minima. A set is done
after step j if all its slots hold values of steps up to j: later offers are larger. Large sets end after one or two steps.
"""

from __future__ import annotations

import numpy as np

from ._common import U64, mix

SLOTS = 128
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are held at once.
_CHUNK = 1 << 15


def _draw(elements: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The value offered in step j (step in the top 8 bits, 56 random bits below), and the place swapped with place j."""
    x = mix(elements + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    place = U64(j) + (mix(x ^ U64(0xD1B54A32D192ED03)) >> U64(33)) * U64(slots - j) // U64(1 << 31)
    return U64(j) << U64(56) | x >> U64(8), place.astype(np.int64)


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A (sets, slots) array for sets elements[offsets[i]:offsets[i + 1]] of distinct 64-bit hashes; empty sets are all ones."""
    n = len(offsets) - 1
    out = np.full((n, slots), _EMPTY, np.uint64)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    flat = out.ravel()
    if not len(elements):
        return out
    # step 0 needs no permutation: the slot is the place drawn
    value, place = _draw(elements, 0, slots)
    np.minimum.at(flat, owner * slots + place, value)
    live = np.flatnonzero((out == _EMPTY).any(axis=1) & (sizes > 0))
    # further steps, for chunks of whole sets
    i = 0
    while i < len(live):
        j = i + max(1, int(np.searchsorted(np.cumsum(sizes[live[i:]]), _CHUNK, "right")))
        _finish(out, elements, offsets, live[i:j], slots)
        i = j
    return out


def _finish(out: np.ndarray, elements: np.ndarray, offsets: np.ndarray, sets: np.ndarray, slots: int) -> None:
    from ._common import ragged

    sizes = offsets[sets + 1] - offsets[sets]
    own = elements[ragged(offsets[sets], sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    sig = out[sets]
    flat = sig.ravel()
    rows = np.arange(len(own))
    perm = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(own), slots)).copy()
    for j in range(slots):
        value, place = _draw(own, j, slots)
        slot = perm[rows, place]
        perm[rows, place] = perm[rows, j]
        if j:
            np.minimum.at(flat, owner * slots + slot, value)
        top = sig.max(axis=1)
        going = (top == _EMPTY) | ((top >> U64(56)) > U64(j))
        if not going.any():
            break
        keep = going[owner]
        if keep.mean() < 0.7:
            own, owner, perm = own[keep], owner[keep], perm[keep]
            rows = np.arange(len(own))
            if not len(own):
                break
    out[sets] = sig


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of the Jaccard similarity of two signatures."""
    return float((a == b).mean())
