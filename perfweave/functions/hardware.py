"""GPU-name rules: architecture family and hardware flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col_, contains_any

# ---------------------------------------------------------------------------
# Name fragments of the rules (upper-case tests for the family,
# lower-case for the flags).  Order of the family rules matters.
# ---------------------------------------------------------------------------
HOPPER_KEYS = ("H100", "H200")
ADA_KEYS = ("L40S", "L40", "L4", "RTX 4000", " ADA")
ADA_PATTERN = r"RTX\s*5\d{3}"
AMPERE_KEYS = ("A100", "A40", "A10")
TURING_KEYS = ("V100", "T4")
PASCAL_KEYS = ("P100", "P4")
TENSOR_CORE_KEYS = ("a100", "a40", "a10", "l40", "l4", "h100", "rtx 50",
                    "rtx 5090", "v100", "t4")
DATACENTER_KEYS = ("a100", "h100", "v100", "a40", "l40", "l4", "a10", "t4",
                   "p100", "p4")
PCIE_PATTERN = "(?i)PCIE|PCIe|PCI-E"


def _upper_has(u: Column, keys) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | u.contains(k)
    return out


def arch_family(name) -> Column:
    """Architecture family from a GPU name; first matching rule wins."""
    u = F.upper(F.coalesce(col_(name).cast("string"), F.lit("nan")))
    return (F.when(_upper_has(u, HOPPER_KEYS), "Hopper")
            .when(_upper_has(u, ADA_KEYS) | u.rlike(ADA_PATTERN), "Ada")
            .when(_upper_has(u, AMPERE_KEYS), "Ampere")
            .when(_upper_has(u, TURING_KEYS), "Turing")
            .when(_upper_has(u, PASCAL_KEYS), "Pascal")
            .otherwise("Unknown"))


def has_tensor_cores(name) -> Column:
    return contains_any(name, TENSOR_CORE_KEYS).cast("int")


def is_datacenter(name) -> Column:
    return contains_any(name, DATACENTER_KEYS).cast("int")


def _matches(c, pattern: str) -> Column:
    return F.coalesce(col_(c).cast("string").rlike(pattern), F.lit(False)).cast("int")


def is_pcie(name) -> Column:
    return _matches(name, PCIE_PATTERN)


def is_sxm(name) -> Column:
    return _matches(name, "(?i)SXM")


def has_hbm(mem_type) -> Column:
    return _matches(mem_type, "(?i)HBM")
