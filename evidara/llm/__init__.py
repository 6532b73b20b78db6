"""Training-data operators: filtering, de-duplication, decontamination, mixing and search."""
