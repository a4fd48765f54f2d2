"""Views, studies and the question catalogue, composed from the operators."""
