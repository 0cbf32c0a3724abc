"""Operators: row-local reversible ones (``make``, ``OPS``) and those on whole DataFrames."""

from . import arith, arrays, dates, encode, masking, packing, plumbing, predicates, reduce, text
from .base import OPS, Elementwise, Op, make

__all__ = ["OPS", "Elementwise", "Op", "arith", "arrays", "dates", "encode", "make", "masking", "packing", "plumbing", "predicates", "reduce", "text"]
