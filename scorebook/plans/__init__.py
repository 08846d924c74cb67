"""Jobs that combine several operators: odds, model training and scoring."""
