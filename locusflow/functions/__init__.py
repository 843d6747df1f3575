"""Column functions for alleles, sequences, CIGAR strings and qualities."""
