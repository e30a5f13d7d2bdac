"""Training-data operators: filtering, extraction, de-duplication, mixing, packing, sharding."""
