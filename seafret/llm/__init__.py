"""Training-data operators: tokens, decontamination, licences, pages, languages, duplicates, toxicity.

Nothing else in the library imports this subpackage. Every operator is a function over DataFrames;
`queries` registers one query per operator and the pipeline over all stages.
"""
