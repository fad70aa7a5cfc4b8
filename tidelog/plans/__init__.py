"""What reads and writes are made of: bounds, schemas and predicates."""
