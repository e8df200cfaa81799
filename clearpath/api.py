"""What users of the library add of their own: rules, finders, formats and standards.

    @rule("mine/no-blink", "2.2.2", "error")
    def no_blink(t): return found(t.nodes.filter(tag("blink")), "Text blinks.")

``rule`` and ``finder`` register a function from tables to a DataFrame, ``element_rule``
a condition on one element, ``place_rule`` and ``sheet_rule`` conditions on an element's place
and on a style rule, ``python_rule`` a function on some elements in pandas, ``formatter`` a function from findings to a column ``value``,
``define_standard`` the criteria of a standard. A rule's id may be registered again; the
last one counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators.finders import finder
from .operators.registry import Tables, element_rule, place_rule, python_rule, rule, run_isolated, run_rules, sheet_rule
from .operators.rules import found
from .plans.standards import define_standard
from .sources.sinks import FORMATS

__all__ = ["Tables", "define_standard", "element_rule", "finder", "formatter", "found", "place_rule", "python_rule", "rule", "run_isolated", "run_rules", "sheet_rule"]


def formatter(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    def keep(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FORMATS[name] = make
        return make

    return keep
