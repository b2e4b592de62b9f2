"""Operators for large text collections used as training data.

Nothing outside this subpackage imports it. Every operator selects the columns it
needs from its input first, so extra or clashing columns never matter.
"""
