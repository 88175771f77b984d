"""Targets of a mix, computed one source after the other."""


def targets_of(sizes, weights, share=1.5, cap=2.0):
    total, out = share * sum(sizes), [0.0] * len(sizes)
    left = list(range(len(sizes)))
    while left:
        weight = sum(weights[i] for i in left)
        over = [i for i in left if total * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = total * weights[i] / weight
            break
        for i in over:
            out[i] = cap * sizes[i]
            total -= out[i]
        left = [i for i in left if i not in set(over)]
    return out
