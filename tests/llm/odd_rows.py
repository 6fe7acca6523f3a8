"""Rows that every operator must take: nulls, empty and blank texts, repeated rows."""

ODD = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "a b c")]
