"""Best-fit decreasing and certified lower bounds over integer lengths, for one group of pieces."""

from __future__ import annotations

import numpy as np


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each length; longest first, each into the fullest bin it fits.

    Bins of equal room are interchangeable, so one stack for each room and a bit set of the
    rooms in use find the best bin without a search.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, opened = 0, 0
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = in_use >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            which = stacks[room].pop()
            if not stacks[room]:
                in_use &= ~(1 << room)
        else:
            room, which = capacity, opened
            opened += 1
        bins[at], offsets[at] = which, capacity - room
        left = room - length
        if left:
            stacks[left].append(which)
            in_use |= 1 << left
    return bins, offsets


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat, from dual feasible functions.

    A function that keeps the sum of every set of lengths which fits one bin at or below one
    turns the sum over all lengths into a bound. Used are the identity, the threshold functions
    (long pieces count as a bin, short ones as nothing) and the rounding functions
    ``floor((k + 1) x / C) / k`` where ``(k + 1) x / C`` is no integer, ``x / C`` where it is.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * size).sum())
    best = -(-total // capacity)
    number, weight = np.cumsum(count), np.cumsum(count * size)
    for short in range(1, capacity // 2 + 1):
        long = int(number[capacity] - number[capacity - short])
        kept = int(weight[capacity - short] - weight[short - 1])
        best = max(best, long - (-kept // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        # over the common denominator k * capacity
        value = np.where(whole, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best
