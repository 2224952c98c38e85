"""The expression constraint language: syntax trees and parser."""

from .parser import parse
from .tree import EclError, ParseError

__all__ = ["EclError", "ParseError", "parse"]
