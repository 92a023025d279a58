"""Training-data operators: ten corpus components and their registered queries.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
