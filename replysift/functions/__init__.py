"""Column expressions: text helpers, the validity rule and the rule scorer."""
