"""Operations for preparing training data: scanning, extraction, de-duplication, filtering, packing."""
