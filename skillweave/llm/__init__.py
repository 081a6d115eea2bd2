"""Operators that prepare training corpora: one module per operator, plus their thin queries."""
