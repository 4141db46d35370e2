"""Operators of a training-data pipeline: one module per operator, and `queries` with the registered ones.

`text` (byte and word hashing over Arrow buffers), `storage` (tables in the shared folder) and
`components` (connected components) are used by several of them.
"""
