"""Operators for preparing language-model training data.

Every operator takes any DataFrame with an id column and a text column, reads
whole texts, and treats a null text as empty. Columns it does not need are never
read, so extra columns of any name do no harm.
"""
