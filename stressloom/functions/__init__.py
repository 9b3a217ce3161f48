"""stressloom.functions"""
