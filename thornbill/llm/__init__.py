"""Operators that prepare text for training and evaluating language models. Nothing else imports this package."""
