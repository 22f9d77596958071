"""Vocabularies and constants of the code graph, as fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ELEMENT_TYPES = ("class", "method", "function", "variable", "field", "interface", "module", "namespace", "package", "enum", "struct")
#: Base strength of relationships when a graph is built.
BASE_STRENGTH = {"inherits": 0.9, "implements": 0.8, "composes": 0.7, "calls": 0.6, "depends": 0.5, "imports": 0.4}
OTHER_STRENGTH = 0.5
#: Weight of a hop in impact scores, and coefficient of the node that is reached.
HOP_WEIGHT = {"calls": 0.8, "inherits": 0.9, "implements": 0.9, "depends": 0.7, "imports": 0.6, "composition": 0.8, "aggregation": 0.6, "uses": 0.5}
NODE_COEFFICIENT = {"class": 1.0, "interface": 1.2, "method": 0.8, "function": 0.8, "variable": 0.6, "field": 0.6, "module": 1.1, "namespace": 1.1}
OTHER_HOP = OTHER_COEFFICIENT = 0.5
#: Weight of a node's type in grades.
GRADE_TYPE = {"interface": 1.0, "class": 0.9, "module": 0.8, "namespace": 0.8, "method": 0.7, "function": 0.7, "variable": 0.5, "field": 0.5}
IMPACT_LEVELS = ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW"))
SECURITY_RULES = (
    ("sql_injection", r"(SELECT|INSERT|UPDATE|DELETE).*\+", "high"),
    ("xss_risk", r"innerHTML\s*=\s*.*\+|document\.write\s*\(.*\+", "medium"),
    ("hardcoded_password", r"(password|pwd|secret|key)\s*=\s*['\"].{4,}['\"]", "critical"),
    ("weak_crypto", r"(MD5|SHA1|DES)\s*\(", "medium"),
    ("path_traversal", r"\.\.[\\/]|\.\.%2[fF]|\.\.%5[cC]", "high"),
    ("command_injection", r"(exec|system|eval|Runtime\.getRuntime)\s*\(.*\+", "critical"),
)


def lookup(values: dict, key: Column, other) -> Column:
    """CASE over a small table; null and unknown keys give ``other``."""
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(key == k, v)
    return out.otherwise(other)


def graded(x: Column, steps, other: str) -> Column:
    """The first step that x reaches."""
    out = None
    for least, name in steps:
        out = (F if out is None else out).when(x >= least, name)
    return out.otherwise(other)
