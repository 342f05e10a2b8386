"""Writers (partitioned overwrite / append)."""
