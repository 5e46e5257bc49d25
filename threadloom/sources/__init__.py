"""Readers and writers. A missing source reads as empty; a written table is counted again."""
