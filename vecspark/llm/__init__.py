"""Operations of a training-data pipeline: tokens, packing, sharding, filtering, de-duplication, mixing.

Nothing else in the package imports this subpackage; ``queries.py`` registers its queries.
"""
