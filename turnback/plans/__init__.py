"""Graphs of operators and fitted encoders."""

from .encoders import Categorical, Dataset, Datetime, Encoder, Fourier, Multilingual, Numeric, Text
from .flow import Flow, Port

__all__ = ["Categorical", "Dataset", "Datetime", "Encoder", "Flow", "Fourier", "Multilingual", "Numeric", "Port", "Text"]
