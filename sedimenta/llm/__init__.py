"""Operators for text corpora: encoding, mixing, residue detection. Nothing else imports this package."""
