"""Operators for preparing language-model training text.

Nothing outside this folder imports it. Each module holds one operator;
``queries`` holds the thin registered queries over them.
"""
