"""Token arrays: truncations that keep what must stay, score penalties, and operation counts from shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(a: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(a, 1, n)


def tail(a: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def drop_before_last(a: Column, n: int) -> Column:
    """Drops n elements before the last one, which stays: a closing tag."""
    return F.concat(F.slice(a, 1, F.greatest(F.size(a) - n - 1, F.lit(0))), F.slice(a, -1, 1))


def suppress_seen(scores: Column, seen: Column, tokens: list[int]) -> Column:
    """The scores with those of the given tokens (from 0) set to minus infinity where they occur among seen."""
    never = F.lit(float("-inf"))
    return F.transform(scores, lambda s, i: F.when(i.isin(tokens) & F.array_contains(seen, i), never).otherwise(s))


def decay_penalty(scores: Column, length: Column, token: int, factor: float, start: int) -> Column:
    """Adds |score| * (factor ** (length - start) - 1) to a token's score once the length is beyond start."""
    extra = lambda s: F.abs(s) * (F.pow(F.lit(factor), length - start) - 1)
    return F.transform(scores, lambda s, i: F.when((i == token) & (length > start), s + extra(s)).otherwise(s))


def sequential_decay(scores: Column, seen: Column, tokens: list[int], factors: list[float]) -> Column:
    """decay_penalty for several tokens in turn: each starts at the length at which the token before it was last seen."""
    n = F.size(seen)
    out = scores
    for i, (token, factor) in enumerate(zip(tokens, factors, strict=True)):
        start = F.lit(0) if i == 0 else n - F.array_position(F.reverse(seen), tokens[i - 1]).cast("int") + 1
        active = F.lit(True) if i == 0 else F.array_contains(seen, tokens[i - 1])
        out = _decayed(out, token, factor, active & (n > start), n - start)
    return out


def _decayed(scores: Column, token: int, factor: float, active: Column, steps: Column) -> Column:
    return F.transform(scores, lambda s, i: F.when((i == token) & active, s + F.abs(s) * (F.pow(F.lit(factor), steps) - 1)).otherwise(s))


def product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda p, x: p * x)


def matmul_ops(a: Column, b: Column) -> Column:
    """Multiplications of a product of matrices of shapes a and b."""
    return product(a) * F.element_at(b, -1)


def conv_ops(x: Column, w: Column, out: Column, transposed: Column) -> Column:
    """Multiplications of a convolution: batch * weights * positions of the output, or of the input if transposed."""
    space = F.when(transposed, x).otherwise(out)
    return F.element_at(x, 1) * product(w) * product(F.slice(space, 3, 100))


def addmm_ops(a: Column, b: Column) -> Column:
    """Multiplications of a fully connected layer: rows and columns of the input by columns of the weights; the bias is none."""
    return F.element_at(a, 1).cast("bigint") * F.element_at(a, 2) * F.element_at(b, 2)


def bmm_ops(a: Column, b: Column) -> Column:
    """Multiplications of a batch of matrix products."""
    return product(F.slice(a, 1, 3)) * F.element_at(b, -1)


def swapped(shape: Column) -> Column:
    """A shape with its first two dimensions exchanged."""
    return F.concat(F.array(F.element_at(shape, 2), F.element_at(shape, 1)), F.slice(shape, 3, 100))


def conv_backward_ops(grad: Column, x: Column, w: Column, transposed: Column, to_input: Column, to_weights: Column) -> Column:
    """Multiplications of a convolution's gradients: that of its input is the opposite convolution of grad with the weights,
    that of its weights the convolution of the input, batch and channels exchanged, with grad."""
    into_x = F.when(to_input, conv_ops(grad, w, x, ~transposed)).otherwise(0)
    into_w = F.when(to_weights, conv_ops(swapped(x), grad, w, transposed)).otherwise(0)
    return into_x + into_w


def utilisation(operations: Column, seconds: Column, peak_per_second: Column) -> Column:
    """Per cent of the peak that was used; null where no time passed."""
    return operations / F.nullif(seconds, F.lit(0.0)) / peak_per_second * 100


#: Score processors by the name that settings give; each takes (scores, seen tokens, settings).
PROCESSORS = {
    "suppress_seen": lambda scores, seen, s: suppress_seen(scores, seen, s["tokens"]),
    "length_decay": lambda scores, seen, s: decay_penalty(scores, F.size(seen), s["token"], s["factor"], s["start"]),
    "sequential_decay": lambda scores, seen, s: sequential_decay(scores, seen, s["tokens"], s["factors"]),
}


def processed(scores: Column, seen: Column, chain: list[dict]) -> Column:
    """The scores after a chain of processors, each a dict of its name and settings; nothing is imported by name."""
    for one in chain:
        if one["name"] not in PROCESSORS:
            raise KeyError(f"no processor {one['name']}; there are {', '.join(PROCESSORS)}")
        scores = PROCESSORS[one["name"]](scores, seen, one)
    return scores
