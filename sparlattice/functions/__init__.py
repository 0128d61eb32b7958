"""Column functions and driver-side helpers: parsing, canonical forms, keys."""
