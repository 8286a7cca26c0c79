class DataContractError(ValueError):
    """Input breaks a rule that an operator must not paper over."""
