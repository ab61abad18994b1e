"""Training-data operators (one module per operator) and their registered queries.

Nothing else in the package imports this subpackage. ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL twins.
"""
