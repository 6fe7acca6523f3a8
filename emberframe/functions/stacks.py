"""Column functions on frame names and stacks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wrapper frames that every stack ends in and that are dropped.
WRAPPER_FRAMES = ["runtime.goexit", "runtime.main"]

# Pseudo-stacks with a band of their own.
BANDS = {"(GC)": "gc", "(Heap)": "heap", "(Blocked)": "blocked"}

# FNV-1a, 32 bit.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619


def trim_package(name: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(name, "/", -1)


def normalise_stack(names: Column) -> Column:
    """Leaf-first function names to a root-first stack without import paths, gaps and wrapper frames."""
    trimmed = F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), trim_package)
    return F.reverse(F.filter(trimmed, lambda n: ~n.isin(WRAPPER_FRAMES)))


def exclude_packages(stack: Column, packages: list[str]) -> Column:
    """Drop the frames of the listed packages. Our definition: a frame ``pkg.Func`` belongs to ``pkg``, where
    a listed import path counts by its last element, as frames carry no import path."""
    short = [p.rsplit("/", 1)[-1] for p in packages]
    return F.filter(stack, lambda f: ~F.substring_index(f, ".", 1).isin(short)) if short else stack


def frame_band(name: Column, value: Column) -> Column:
    """Band of a frame: a pseudo-stack, else ``shrinking`` for negative values, else ``other``."""
    band = F.when(value < 0, F.lit("shrinking")).otherwise(F.lit("other"))
    for pseudo, label in BANDS.items():
        band = F.when(name == pseudo, F.lit(label)).otherwise(band)
    return band


def fnv1a32(text: Column) -> Column:
    """FNV-1a hash, 32 bit, of the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    positions = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(
        positions,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, i: F.pmod(
            h.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) * FNV_PRIME, F.lit(2**32)
        ),
    )


def stable_hash_bucket(text: Column, buckets: int = 360) -> Column:
    return F.pmod(fnv1a32(text), F.lit(buckets).cast("long"))
