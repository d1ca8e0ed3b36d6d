"""Column functions and the few Arrow functions the operators need."""
