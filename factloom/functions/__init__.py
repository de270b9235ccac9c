"""Column expressions: values, text similarity, codes, form fields, check digits."""
