"""Operations for preparing text at large scale; nothing else in the package imports this one."""
