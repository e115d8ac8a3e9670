"""Column -> Column functions: text (T*), edit distance (T24), label arrays (L*)."""
