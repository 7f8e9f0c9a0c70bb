"""Greedy placement of weighted groups, done in bulk over the histogram of their sizes.

The greedy rule looks only at a group's size, so all groups of one size are placed together and the
driver sees one row per distinct size: with N records in all there are fewer than sqrt(2N) of them.
"""

from __future__ import annotations


def fill_targets(histogram: list[tuple[int, int]], targets: list[float]) -> list[tuple[int, int, int, int]]:
    """Largest first, each group to the bin furthest below its target (the first of equals).

    ``histogram``: (size, groups).  Gives (size, bin, lo, hi): of the groups of that size, in some
    fixed order from 1, those with lo < rank <= hi go to the bin.
    """
    short = list(targets)
    out = []
    for size, count in sorted(histogram, reverse=True):
        taken = [0] * len(short)
        left = count
        if size > 0 and left > 4 * len(short):
            # Bins that stay above the water level take none; the level is where `left` groups fit.
            order = sorted(range(len(short)), key=lambda i: -short[i])
            level = 0.0
            for k in range(1, len(order) + 1):
                level = (sum(short[i] for i in order[:k]) - left * size) / k
                if k == len(order) or short[order[k]] <= level:
                    break
            for i in order:
                # One less than the level allows, so that the exact rule settles the last few.
                taken[i] = max(0, int((short[i] - level) // size) - 1)
                short[i] -= taken[i] * size
            left -= sum(taken)
        for _ in range(left):
            i = max(range(len(short)), key=lambda j: (short[j], -j))
            taken[i] += 1
            short[i] -= size
        lo = 0
        for i, n in enumerate(taken):
            if n:
                out.append((size, i, lo, lo + n))
                lo += n
    return out
