"""Operations of a training-data pipeline: packing, archives, decontamination, filters, de-duplication and privacy.

Nothing else in the package imports this subpackage.
"""
