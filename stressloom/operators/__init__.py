"""stressloom.operators"""
