"""Operations of a training-data pipeline: sharding, deduplication, fingerprints,
personal data, quality, mixing, subword encoding, compressed id files, filter audit,
fill-in-middle and sequence packing.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
